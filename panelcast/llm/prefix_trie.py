"""Conversation prefix trie with subtree totals rolled up in depth bands.

Turns are cut into slices of the global order (conversation, turn), so that a
conversation of any length is numbered without a task of its own. A
conversation is rebuilt as the first turns of the conversation it starts like
and its own turns after as many; a prefix of it is named by 128 bits, the XOR
of its turns' hashes (place, role, text), which add up like a running sum:
within a slice's piece by a window, across pieces by one row per piece. Rows
with equal names are one node of the trie; members are counted and their
smallest is found by an aggregate that is combined before the shuffle.

Subtree totals. The trie is cut into bands of ``BAND`` levels. A node adds its
own values to its ancestors within its band only, so a row explodes to at most
``BAND`` rows. The roots of the bands, with their bands' totals, form a trie
whose depth is ``BAND`` times smaller, which is rolled up in the same way. When
a single band is left its totals are complete, and each level hands the
completed totals of its band roots to the nodes of the band above. Rounds grow
with the logarithm of the depth. A node finds its ancestors in the path of
its smallest member, grouped by (conversation, band).

The ids that end at a node are ordered by range, joined to texts of up to
``CHUNK`` ids in parallel, and a node's texts are streamed through SHA-256 in
order; no list of a node's members is ever held.

Defined cases: rows without a conv_id belong to no conversation and take no
part; a null turn comes first, and rows of equal turn go by the SHA-256 of
role and text; repeated rows are turns like others; null role or text is
empty; a rebuilt conversation without turns ends at the root; conv_id % 100
has the sign of conv_id; very long texts only enter as hash and length;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import join_counted
from panelcast.operators.slices import PIECE, earlier_pieces, range_slices
from panelcast.session import materialize

#: Levels of a band: the most ancestors that one row is copied to.
BAND = 16
#: Conversation ids of one text.
CHUNK = 4096
#: A rebuilt conversation takes fewer turns than this from the one it starts like.
SHARED = 6
GROUP = 100


def borrowed(c: Column) -> Column:
    """How many turns conversation ``c`` takes from the one it starts like."""
    return F.crc32(c.cast("string").cast("binary")) % SHARED


def _hashes(place: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), place.cast("long"), F.col("digest")) for salt in (1, 2)]


def _xor(name: str, *more: str) -> Column:
    out = F.col(name)
    for m in more:
        out = out.bitwiseXOR(F.coalesce(F.col(m), F.lit(0).cast("long")))
    return out


def paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """Written rows (c, d, node, parent, chars): every prefix of every rebuilt conversation,
    from the root (d = 0) on."""
    said_by, said = (F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in (role, text))
    turns = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, said).cast("binary"), 256)).alias("digest"),
        F.length(said).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    s = range_slices(turns, "c", ("turn", "digest", "tie"))
    pieces = s.pieces.withColumn("c", F.col("_k.k"))
    sizes = pieces.groupBy("c").agg(F.max("_n").alias("n")).withColumn("h", borrowed(F.col("c")))
    sizes = sizes.withColumn("start", F.col("c") - F.col("c") % GROUP)
    like = sizes.select(F.col("c").alias("start"), F.col("n").alias("n_start"))
    convs = materialize(sizes.join(like, "start", "left").select(
        "c", "start", "h", F.least("h", F.coalesce("n_start", F.lit(0))).alias("m")), "trie-convs")

    numbered = (s.rows.drop("c").join(pieces.join(convs, "c").select(*PIECE, "c", "_off", "h", "m"), PIECE)
                .withColumn("i", F.col("_off") + F.row_number().over(s.window()) - 1))
    numbered = materialize(numbered.select(*PIECE, "c", "i", "h", "m", "digest", "chars"), "trie-turns")
    # The first turns of a conversation, for those that start like it (fewer than SHARED rows each).
    first = numbered.where(F.col("i") < SHARED - 1).select(F.col("c").alias("start"), "i", "digest", "chars")
    place = F.col("i") + 1
    head = (convs.select("c", "start", "h").join(first, "start").where("i < h")
            .select("c", place.alias("d"), "chars", *[x.alias(n) for x, n in zip(_hashes(place), ("xa", "xb"))]))
    head = materialize(head, "trie-heads")
    so_far = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    heads = head.select("c", "d", "chars", "xa", "xb", F.bit_xor("xa").over(so_far).alias("a"),
                        F.bit_xor("xb").over(so_far).alias("b"))
    head_sums = head.groupBy("c").agg(F.bit_xor("xa").alias("head_a"), F.bit_xor("xb").alias("head_b"))

    place = F.col("i") - F.col("h") + F.col("m") + 1
    own = numbered.where("i >= h").select(*PIECE, "c", place.alias("d"), "chars",
                                          *[x.alias(n) for x, n in zip(_hashes(place), ("xa", "xb"))])
    own = materialize(own, "trie-own")
    sums = own.groupBy(*PIECE, "c").agg(F.bit_xor("xa").alias("pa"), F.bit_xor("xb").alias("pb"))
    before = (sums.withColumn("la", F.bit_xor("pa").over(earlier_pieces()))
              .withColumn("lb", F.bit_xor("pb").over(earlier_pieces())).join(head_sums, "c", "left")
              .select(*PIECE, "la", "lb", "head_a", "head_b"))
    so_far = Window.partitionBy(*PIECE).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = (own.join(before, PIECE).withColumn("ra", F.bit_xor("xa").over(so_far))
            .withColumn("rb", F.bit_xor("xb").over(so_far))
            .select("c", "d", "chars", "xa", "xb", _xor("ra", "la", "head_a").alias("a"), _xor("rb", "lb", "head_b").alias("b")))

    def node(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    zero = F.lit(0).cast("long")
    root = convs.select("c", zero.alias("d"), node(zero, zero).alias("node"),
                        F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), zero.alias("chars"))
    below = rows.unionByName(heads).select(
        "c", F.col("d").cast("long").alias("d"), node(F.col("a"), F.col("b")).alias("node"),
        node(_xor("a", "xa"), _xor("b", "xb")).alias("parent"), "chars")
    return materialize(root.unionByName(below), "trie-paths")


def nodes_of(all_paths: DataFrame) -> DataFrame:
    """Written rows, one per node: node, parent, c (smallest member), d, n_convs, n_children, saved."""
    n = all_paths.groupBy("node").agg(F.min("c").alias("c"), F.min("d").alias("d"), F.count(F.lit(1)).alias("n_convs"),
                                      F.min("parent").alias("parent"), F.min("chars").alias("chars"))
    n = materialize(n, "trie-members")
    children = n.where("d > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return materialize(n.join(children.hint("shuffle_hash"), "node", "left").select(
        "node", "parent", "c", "d", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-nodes")


def subtree_sums(all_paths: DataFrame, nodes: DataFrame, values: tuple[str, ...], band: int = BAND) -> DataFrame:
    """(node, *values) summed over each node's subtree. ``nodes`` has node, c, d and the values."""
    if band < 2:
        raise ValueError("a band has two levels at least")

    def trail(level: int) -> DataFrame:
        """(c, band, trail): the level's nodes of a path, at most ``band`` in a row."""
        step = band ** level
        p = all_paths.where(F.col("d") % step == 0).select("c", F.expr(f"d div {step}").alias("d"), "node")
        return p.groupBy("c", F.expr(f"d div {band}").alias("band")).agg(
            F.collect_list(F.struct("d", "node")).alias("trail"))

    def handed(rows: DataFrame, level: int) -> DataFrame:
        """Every row's values for each node of its path in ``band``, from the top to depth ``upto``."""
        meet = rows.join(trail(level), ["c", "band"])
        up = F.explode(F.filter("trail", lambda x: x["d"] <= F.col("upto")))
        return meet.select(up.alias("up"), *values).select("up.node", *values)

    deepest = nodes.agg(F.max("d")).first()[0] or 0
    own, in_band = nodes.select("node", "c", "d", *values), []
    while True:
        level = len(in_band)
        rows = own.withColumns({"band": F.expr(f"d div {band}"), "upto": F.col("d")})
        sums = handed(rows, level).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])
        in_band.append(materialize(own.select("node", "c", "d").join(sums, "node"), f"trie-band-{level}"))
        if deepest < band ** (level + 1):
            break
        own = (in_band[-1].where(F.col("d") % band == 0).withColumn("d", F.expr(f"d div {band}")))
    done = in_band.pop()
    while in_band:
        # Completed totals of the band roots go to the band above, which ends just before them.
        level = len(in_band) - 1
        roots = done.where("d > 0").withColumns({"band": F.col("d") - 1, "upto": F.col("d") * band})
        sums = in_band[level].select("node", *values).unionByName(handed(roots, level)).groupBy("node").agg(
            *[F.sum(v).alias(v) for v in values])
        done = materialize(in_band.pop().select("node", "c", "d").join(sums, "node"), f"trie-total-{level}")
    return done.select("node", *values)


def end_digests(all_paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end."""
    ends = (all_paths.groupBy("c").agg(F.max_by("node", "d").alias("end"))
            .select(F.col("end.a").alias("a"), F.col("end.b").alias("b"), "c"))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, out = None, [], []
        for batch in batches:
            for a, b, c in zip(batch["a"].tolist(), batch["b"].tolist(), batch["c"].tolist()):
                if now != (a, b) or len(ids) == CHUNK:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = (a, b), []
                ids.append(c)
            yield pd.DataFrame(out, columns=["a", "b", "first", "ids"])
            out = []
        if ids:
            yield pd.DataFrame([(*now, ids[0], ",".join(map(str, ids)))], columns=["a", "b", "first", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ids"]):
                if now != (a, b):
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
            out = []
        if now:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["a", "b", "ends_sha256"])

    sliced = ends.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
    chunks = sliced.mapInPandas(texts, "a long, b long, first long, ids string")
    done = (chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first")
            .mapInPandas(digests, "a long, b long, ends_sha256 string"))
    return done.select(F.struct("a", "b").alias("node"), "ends_sha256")


def trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations."""
    all_paths = paths(conversations)
    nodes = nodes_of(all_paths)
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    totals = subtree_sums(all_paths, nodes.select("node", "c", "d", leaf.alias("n_leaves"), F.col("saved").alias("saved_tokens")),
                          ("n_leaves", "saved_tokens"), band)
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("c").alias("parent_conv_id"),
                                                   F.col("n_children").alias("weight"))
    below = nodes.where("d > 0")
    with_parent = join_counted(below, parents, "parent", "weight", below.count()).drop("weight")
    every = with_parent.unionByName(nodes.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    none = hashlib.sha256(b"").hexdigest()
    return (every.join(totals, "node").join(end_digests(all_paths), "node", "left")
            .select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return trie(conversations)


#: The CRC-32 of the decimal id is taken bit by bit: -1 stands for one step of the register.
ORACLE_SQL = """
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST,
                                   sha256(strlen(role) || ':' || role || text)) - 1 AS i FROM t),
n AS (SELECT c, count(*) AS n, c - c % 100 AS start, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
v AS (SELECT c, n, start,
        xor(list_reduce(list_concat([4294967295::BIGINT],
              flatten(list_transform(range(1, length(s) + 1),
                      lambda k: [ascii(substr(s, CAST(k AS INT), 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM n),
m AS (SELECT v.c, v.h, v.start, least(v.h, coalesce(w.n, 0)) AS m FROM v LEFT JOIN v w ON w.c = v.start),
r AS (SELECT m.c, o.i + 1 AS d, role, text FROM m JOIN o ON o.c = m.start WHERE o.i < m.h
      UNION ALL SELECT m.c, o.i - m.h + m.m + 1, role, text FROM m JOIN o ON o.c = m.c WHERE o.i >= m.h),
p AS (SELECT c, 0 AS d, '' AS k, '' AS up, 0 AS chars FROM m
      UNION ALL SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING),
                       coalesce(string_agg(x, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
                       length(text)
                FROM (SELECT *, md5(strlen(role) || ':' || role || text) AS x FROM r)),
e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
g AS (SELECT p.k, any_value(p.up) AS up, any_value(p.d) AS d, min(p.c) AS c, count(*) AS n, any_value(chars) AS chars,
             sha256(coalesce(string_agg(CAST(e.c AS VARCHAR), ',' ORDER BY e.c), '')) AS ends
      FROM p LEFT JOIN e ON e.c = p.c AND e.d = p.d GROUP BY p.k),
q AS (SELECT g.*, coalesce(k.n, 0) AS kids FROM g LEFT JOIN (SELECT up, count(*) AS n FROM g WHERE d > 0 GROUP BY up) k ON k.up = g.k),
s AS (SELECT p.k, count(*) FILTER (q.kids = 0) AS leaves, sum((q.n - 1) * q.chars) AS saved
      FROM q JOIN p ON p.c = q.c AND p.d <= q.d GROUP BY p.k)
SELECT q.c AS conv_id, CAST(q.d AS BIGINT) AS depth, u.c AS parent_conv_id, q.n AS n_convs, q.kids AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, q.ends AS ends_sha256
FROM q JOIN s ON s.k = q.k LEFT JOIN g u ON q.d > 0 AND u.k = q.up
"""
