"""Exact top-k inner products by best-first search in a paged M-tree.

Vectors are quantised to integers, and each is lifted by one coordinate so that all
have the same length; a query is lifted by 0. Then a larger inner product is
a smaller Euclidean distance, and the triangle inequality holds.

Index. Its entries are the distinct vectors, each with its ``k`` + 1 smallest ids
(of equal vectors no other can be among the ``k`` best, a query's own row
counted). The tree is built from the top, level by level: a node of more than
``PAGE`` entries draws ``FANOUT`` routing objects by hash, and each entry goes
to the nearest. A node keeps its routing object, its covering radius and the
distance to its parent's routing object; an entry keeps the distance to its
own. Crowded nodes are dealt into groups of bounded size, so no task holds a node,
and all tables are written. Levels grow with the logarithm of the entries.

Search. Every query first goes down to one leaf page, always to the child with
the nearest routing object. The distance found there bounds the rest: of the
nodes left aside, those whose lower bound lies within it are opened level by
level, and pages are visited by rising lower bound in batches that grow
(``BATCHES``), the bound falling after each. A child's distance is computed
only if its stored parent distance and radius do not already exclude it, and
an entry's only if its stored parent distance does not. Only pages and
children that some query of a block visits are sent to it.

Scores are integers and exact: distances serve to exclude only, with a slack
above their rounding error, and products beyond the exact range of doubles
are taken in whole numbers.

Defined cases: null vectors, vectors holding null or non-finite components and
null ids take no part; components and scores beyond the range of a long count
as its end; shorter vectors are read as padded with zeros; of rows that repeat
an id the smallest vector counts, once, and a row is never its own candidate;
ties go to the smaller id; fewer candidates than ``k`` are all returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.session import materialize

K = 5
SCALE = 256
PAGE = 512
FANOUT = 16
#: Entries of a crowded node that meet its routing objects in one task.
GROUP = 8192
#: Queries that meet a node in one task.
QUERY_BLOCK = 4096
#: Pages that a query visits before its bound is taken again; None: all that are left.
BATCHES = (4, 32, None)
#: Node numbers (``FANOUT`` times the parent's and more) fit a long up to this level.
MAX_LEVEL = 14
PAIRS = "query_id long, vec_id long, score long"
FRONTIER = "query_id long, node long, leaf boolean, to_pivot double, low double"
LONGS = np.iinfo(np.int64)


@dataclass
class Tree:
    """The written index: ``entries`` (node, page, parent, v, ids) of the leaves and ``nodes``
    (node, up, leaf, pivot, radius, apart)."""

    entries: DataFrame
    nodes: DataFrame
    top: float  # the common squared length
    dims: int
    depth: int

    @property
    def slack(self) -> float:
        return 1e-6 * math.sqrt(self.top + 1)


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, norm): integer vectors of the rows that take part, one row per id."""
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = F.transform(x, lambda e: F.floor(SCALE * e.cast("double")).cast("long"))
    rows = (vectors.where(F.col(f"`{key}`").isNotNull() & x.isNotNull()).where(whole)
            .select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn(
        "norm", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def _matrix(rows, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q``, exact; ends of the long range beyond it."""
    if len(x) == 0 or np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2.0 ** 53:
        return (x @ q).astype(np.int64)
    whole = [int(c) for c in q.tolist()]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in x.tolist())
    return np.array([min(max(s, LONGS.min), LONGS.max) for s in sums], np.int64)


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))[:, None]], axis=1)


def distinct_vectors(vectors: DataFrame, k: int = K) -> DataFrame:
    """(v, norm, ids): every distinct vector and its ``k`` + 1 smallest ids."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return (vectors.withColumn("place", place).where(F.col("place") <= k + 1)  # also before the shuffle
            .groupBy("v").agg(F.min("norm").alias("norm"), F.sort_array(F.collect_list("vec_id")).alias("ids")))


def build(vectors: DataFrame, k: int = K) -> Tree | None:
    """Index the quantised ``vectors``; None for an empty table."""
    spark = vectors.sparkSession
    start = materialize(distinct_vectors(vectors, k).select(
        F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("parent"), F.lit(None).cast("array<bigint>").alias("pivot"),
        "v", "norm", "ids"), "tree-level-0")
    count, top, dims = start.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v"))).first()
    if not count:
        return None
    top, dims = float(top), int(dims or 0)

    def split(_, entries: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        routes = routes.sort_values("place")
        x, p = _lift(_matrix(entries["v"], dims), top), _lift(_matrix(routes["v"], dims), top)
        d = np.sqrt(np.maximum(2 * top - 2 * (x @ p.T), 0.0))
        near = d.argmin(axis=1)
        pivots = routes["v"].to_numpy()
        return pd.DataFrame({"node": entries["node"].to_numpy() * FANOUT + near + 1, "parent": d[np.arange(len(x)), near],
                             "pivot": pivots[near], "v": entries["v"], "norm": entries["norm"], "ids": entries["ids"]})

    def apart(batches):
        for b in batches:
            a, p = _lift(_matrix(b["pivot"], dims), top), _lift(_matrix(
                [u if u is not None else v for u, v in zip(b["above"], b["pivot"])], dims), top)
            yield pd.DataFrame({"node": b["node"], "apart": np.sqrt(((a - p) ** 2).sum(axis=1))})

    level, now, leaves, nodes = 0, start, None, None
    above = spark.createDataFrame([], "node long, pivot array<long>")
    while True:
        sizes = materialize(now.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("radius"),
                                                    F.min("pivot").alias("pivot")), f"tree-sizes-{level}")
        crowded = F.col("n") > (PAGE if level < MAX_LEVEL else LONGS.max)
        up = F.when(F.col("node") > 0, F.expr(f"(node - 1) div {FANOUT}"))
        own = sizes.select("node", up.alias("up"), (~crowded).alias("leaf"), "pivot", "radius")
        far = (own.where("up is not null").join(above.select(F.col("node").alias("up"), F.col("pivot").alias("above")), "up")
               .mapInPandas(apart, "node long, apart double"))
        own = own.join(far, "node", "left")
        nodes = own if nodes is None else nodes.unionByName(own)
        page = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / (4 * PAGE))).cast("int").alias("page")
        done = now.join(sizes.where(~crowded).select("node", "n"), "node").select("node", page, "parent", "v", "ids")
        leaves = done if leaves is None else leaves.unionByName(done)
        groups = F.ceil(F.col("n") / GROUP).cast("int")
        wide = materialize(sizes.where(crowded).select("node", groups.alias("groups")), f"tree-wide-{level}")
        if wide.isEmpty():
            break
        rest = now.join(wide, "node")
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("v"), "v"))
        drawn = materialize(rest.select("node", "groups", "v", place.alias("place")).where(F.col("place") <= FANOUT),
                            f"tree-routes-{level}")
        drawn = drawn.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("v", F.lit(level)), F.col("groups")).cast("int"))
        level += 1
        above = sizes.select("node", "pivot")
        now = materialize(dealt.groupBy("node", "grp").cogroup(drawn.groupBy("node", "grp")).applyInPandas(
            split, "node long, parent double, pivot array<long>, v array<long>, norm double, ids array<long>"), f"tree-level-{level}")
    return Tree(materialize(leaves, "tree-entries"), materialize(nodes, "tree-nodes"), top, dims, level)


def _opened(tree: Tree):
    """The children of one node that some of the queries may need, with their lower bounds."""
    top, dims, slack = tree.top, tree.dims, tree.slack

    def run(_, kids: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(kids) and len(queries):
            p, q = _matrix(kids["pivot"], dims), _matrix(queries["v"], dims)
            radius, apart = kids["radius"].to_numpy(), kids["apart"].to_numpy()
            node, leaf = kids["node"].to_numpy(), kids["leaf"].to_numpy()
            for i, (query, norm, to_pivot, bound) in enumerate(zip(
                    queries["query_id"], queries["norm"], queries["to_pivot"], queries["bound"])):
                # What the stored distances exclude is not computed (the root has no routing object).
                need = np.ones(len(p), bool) if to_pivot != to_pivot else np.abs(to_pivot - apart) - radius <= bound + slack
                d = np.sqrt(np.maximum(norm + top - 2 * (p[need] @ q[i]), 0.0))
                low = np.maximum(d - radius[need], 0.0)
                ok = low <= bound + slack
                out.append(pd.DataFrame({"query_id": query, "node": node[need][ok], "leaf": leaf[need][ok],
                                         "to_pivot": d[ok], "low": low[ok]}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in FRONTIER.split(", ")])

    return run


def _visited(tree: Tree, k: int, counter=None):
    """Each query's best entries of one page."""
    top, dims, slack = tree.top, tree.dims, tree.slack

    def run(_, page: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(page) and len(queries):
            page = page.sort_values("parent")
            x, q, parent, ids = _matrix(page["v"], dims), _matrix(queries["v"], dims), page["parent"].to_numpy(), page["ids"].tolist()
            to_pivot = queries["to_pivot"].fillna(0.0).to_numpy()
            reach = np.where(queries["to_pivot"].isna(), np.inf, queries["bound"] + slack)
            low, high = np.searchsorted(parent, to_pivot - reach, "left"), np.searchsorted(parent, to_pivot + reach, "right")
            for i, (query, norm, bound) in enumerate(zip(queries["query_id"], queries["norm"], queries["bound"])):
                near = slice(low[i], high[i])
                if counter is not None:
                    counter.add(int(high[i] - low[i]))
                score = _scores(x[near], q[i])
                ok = np.flatnonzero(norm + top - 2.0 * score <= (bound + slack) ** 2)
                if len(ok) > k + 1:  # ties of the last one stay
                    ok = ok[score[ok] >= np.sort(score[ok])[-(k + 1)]]
                found += [(query, who, score[j]) for j in ok for who in ids[low[i] + j] if who != query]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    return run


def _best(pairs: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(tree: Tree, queries: DataFrame, k: int = K, counter=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of every query (quantised rows).

    ``counter`` (an accumulator) adds up the compared entries.
    """
    spark = queries.sparkSession
    queries = materialize(queries.select(F.col("vec_id").alias("query_id"), "v", "norm"), "tree-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    found = spark.createDataFrame([], PAIRS)

    def bounded(rows: DataFrame) -> DataFrame:
        """``rows`` whose lower bound does not exceed the query's bound, with the query."""
        kth = _best(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        bound = F.sqrt(F.greatest(F.col("norm") + F.lit(tree.top) - 2 * F.col("kth"), F.lit(0.0)))
        known = queries.join(kth, "query_id", "left").withColumn(
            "bound", F.when(F.col("kth").isNotNull(), bound).otherwise(F.lit(float("inf")))).drop("kth")
        return rows.join(known, "query_id").where(F.col("low") <= F.col("bound") + tree.slack)

    def together(rows: DataFrame, table: DataFrame, by: list[str], run, schema: str) -> DataFrame:
        """``run`` over the parts of ``table`` and the queries that visit them, per block of queries."""
        visits = bounded(rows).withColumn("block", block)
        anew = lambda *names: [F.col(n).alias(n) for n in names]
        sent = table.join(visits.select(*anew(by[0], "block")).distinct(), by[0])
        if len(by) > 1:  # a query that visits a leaf visits all its pages
            visits = visits.join(table.select(*anew(*by)).distinct(), by[0])
        names = [*by, "block"]
        return sent.groupBy(*names).cogroup(visits.groupBy(*names)).applyInPandas(run, schema)

    kids = tree.nodes.where("up is not null").withColumnRenamed("node", "kid").withColumnRenamed("up", "node")

    def opened(rows: DataFrame, name: str) -> DataFrame:
        run = _opened(tree)
        return materialize(together(rows, kids, ["node"], lambda key, t, q: run(key, t.drop(columns="node").rename(
            columns={"kid": "node"}), q), FRONTIER), name)

    def visit(rows: DataFrame) -> DataFrame:
        new = together(rows, tree.entries, ["node", "page"], _visited(tree, k, counter), PAIRS)
        return materialize(_best(found.unionByName(new), k).drop("rank"), "tree-found")

    # Down to one page, by the nearest routing object; the other children wait.
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy("to_pivot", "node"))
    at = queries.select("query_id", F.lit(0).cast("long").alias("node"), F.lit(tree.depth == 0).alias("leaf"),
                        F.lit(None).cast("double").alias("to_pivot"), F.lit(0.0).alias("low"))
    waiting = spark.createDataFrame([], FRONTIER)
    for level in range(tree.depth):
        ranked = opened(at.where("not leaf"), f"tree-down-{level}").withColumn("r", nearest)
        waiting = waiting.unionByName(ranked.where("r > 1").drop("r"))
        at = at.where("leaf").unionByName(ranked.where("r = 1").drop("r"))
    found = visit(at)
    # What the bound leaves of the waiting nodes is opened down to the pages.
    for level in range(tree.depth):
        within = bounded(waiting).select("query_id", "node", "leaf", "to_pivot", "low")
        waiting = materialize(within.where("leaf").unionByName(opened(within.where("not leaf"), f"tree-open-{level}")),
                              f"tree-waiting-{level}")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("low", "node"))
    waiting = materialize(waiting.withColumn("r", order), "tree-pages")
    done = 0
    for more in BATCHES if tree.depth else ():
        turn = waiting.where(F.col("r") > done)
        if more is not None:
            done += more
            turn = turn.where(F.col("r") <= done)
        found = visit(turn.drop("r"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The five highest integer inner products of every 50th vector."""
    vectors = materialize(quantised(embeddings), "tree-vectors")
    tree = build(vectors)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search(tree, vectors.where(F.col("vec_id") % every == 0))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
