"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the total. Sources whose share
exceeds ``max_epochs`` times their own size are clamped there; the excess is
shared again among the others by weight, until none exceeds its cap. A target
then becomes whole repetitions of the source plus a fraction of one: the
documents are put in a seeded order and taken until the fraction is reached,
the last of them in part, so that every source meets its target to the word.

Nothing per document is collected or ordered globally. Sizes are summed per
source (combined before the shuffle); the fraction is located in 65536 hash
buckets per source, so only the one bucket in which it ends is ordered, and a
source with a third of all rows needs no more than 1/65536 of itself in one
task. The driver sees one aggregate row per round of water-filling.

Defined cases: null text counts 0 words; a null source is a source of its
own, ordered last; documents of size 0 take 0; null and repeated ids are
rows like others (ties in the seeded order fall back on the size); sources
of total size 0 get target 0; very long texts are taken whole (but for the one of
a source that is cut); an empty table gives an empty result; extra columns are
ignored by the query and kept by the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, text_of, words_of
from panelcast.session import materialize

MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the seeded hash that name a bucket (16 ** 4 buckets per source).
BUCKET_DIGITS = 4


def draw_order(key: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          seed: str = SEED) -> DataFrame:
    """Narrow (key, source, size, draw) rows of all documents."""
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"),
                       F.size(words_of(text_of(text))).cast("long").alias("size"),
                       draw_order(F.col(f"`{key}`"), seed).alias("draw"))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight): weights repeat over the sources by code point, null last.

    The sources are sorted and numbered in a distributed way: a written sort
    numbers rows within its partitions, and the partitions' counts shift them.
    """
    slot = F.col("slot")
    ranked = materialize(sources.orderBy(F.col("source").asc_nulls_last())
                         .withColumn("slot", F.monotonically_increasing_id())
                         .withColumn("part", F.shiftright(slot, 33))
                         .withColumn("row", slot.bitwiseAND((1 << 33) - 1)), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    place = (F.col("row") + F.col("shift")) % len(weights)
    return ranked.join(parts, "part").select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` with a double column ``target``. One aggregate row comes back per round."""
    cap, w = F.col("cap"), F.col("weight").cast("decimal(38,0)")
    s = sources.withColumn("cap", (F.col("source_size") * max_epochs).cast("decimal(38,0)"))
    total = s.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    free_size, free_weight, n_full = int(total[0] or 0), int(total[1] or 0), 0
    all_size, all_weight = free_size, free_weight
    while True:
        full = cap * F.lit(free_weight).cast("decimal(20,0)") <= F.lit(free_size).cast("decimal(20,0)") * w
        got = s.where(full).agg(F.sum("cap"), F.sum("weight"), F.count(F.lit(1))).first()
        if got[2] == n_full:
            break
        n_full = got[2]
        free_size, free_weight = all_size - int(got[0]), all_weight - int(got[1])
        if free_weight == 0:
            break
    if free_weight == 0:
        target = cap.cast("double")
    else:
        full = cap * F.lit(free_weight).cast("decimal(20,0)") <= F.lit(free_size).cast("decimal(20,0)") * w
        target = F.when(full, cap.cast("double")).otherwise(
            (F.lit(free_size).cast("decimal(20,0)") * w).cast("double") / F.lit(float(free_weight)))
    return s.withColumn("target", target).drop("cap")


def plan(docs_sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: whole repetitions, the bucket where the fraction ends, and what is left there."""
    need = F.round("target").cast("long")
    s = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.expr(
        "cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("rest", need - F.col("whole") * F.col("source_size"))
    buckets = docs_sized.groupBy("source", bucket_of(F.col("draw")).alias("bucket")).agg(
        F.sum("size").alias("bsize"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = buckets.withColumn("upto", F.sum("bsize").over(upto))
    edge = (run.alias("b").join(s.select("source", "rest").alias("s"),
                                F.col("b.source").eqNullSafe(F.col("s.source")))
            .where(F.col("upto") > F.col("rest"))
            .groupBy(F.col("b.source").alias("source"))
            .agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("bsize")).alias("left"))).alias("edge")))
    return (s.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
            .select("s.source", "s.source_size", "s.target", "s.whole",
                    F.coalesce("edge.bucket", F.lit("")).alias("edge_bucket"),
                    F.coalesce("edge.left", F.lit(0).cast("long")).alias("edge_left")))


def bucket_of(draw: Column) -> Column:
    return F.substring(draw, 1, BUCKET_DIGITS)


def assign(rows: DataFrame, source_plan: DataFrame, out: tuple[str, str, str, str],
           names: tuple[str, str, str, str] = ("key", "source", "size", "draw")) -> DataFrame:
    """``rows`` with columns ``out`` = (source_size, target, whole, extra).

    ``whole`` counts full repetitions, ``extra`` the words of a further,
    fractional one. Only rows of the edge buckets are moved and ordered.
    """
    key, source, size, draw = (F.col(f"`{n}`") for n in names)
    p_source, p_bucket, p_left = fresh(rows, "p_source", "p_bucket", "p_left")
    p = source_plan.select(F.col("source").alias(p_source), F.col("source_size").alias(out[0]),
                           F.col("target").alias(out[1]), F.col("whole").alias(out[2]),
                           F.col("edge_bucket").alias(p_bucket), F.col("edge_left").alias(p_left))
    d = rows.join(p, source.eqNullSafe(F.col(p_source)))
    b = bucket_of(draw)
    sure = d.where(b != F.col(p_bucket)).withColumn(
        out[3], F.when(b < F.col(p_bucket), size).otherwise(F.lit(0)).cast("long"))
    before = Window.partitionBy(source).orderBy(draw, key, size).rowsBetween(Window.unboundedPreceding, -1)
    edge = d.where(b == F.col(p_bucket)).withColumn(
        out[3], F.greatest(F.lit(0), F.least(size, F.col(p_left) - F.coalesce(F.sum(size).over(before), F.lit(0)))).cast("long"))
    return sure.unionByName(edge).drop(p_source, p_bucket, p_left)


def planned(docs_sized: DataFrame) -> DataFrame:
    """The written per-source plan of the production weights."""
    sources = docs_sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialize(plan(docs_sized, water_fill(cyclic_weights(sources))), "mix-plan")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken."""
    s = materialize(sized(docs), "mix-sized")
    got = assign(s, planned(s), ("source_size", "target", "whole", "extra"))
    return got.select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                      (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, columns unchanged: each whole repetition is a
    row, and the one fractional document of a source is cut after its last word taken."""
    p = planned(materialize(sized(docs), "mix-sized"))
    key, source, size, draw, s_size, target, whole, extra, times, copy = fresh(
        docs, "m_key", "m_source", "m_size", "m_draw", "m_source_size", "m_target", "m_whole",
        "m_extra", "m_times", "m_copy")
    d = docs.select("*", F.col("doc_id").alias(key), F.col("source").alias(source),
                    F.size(words_of(text_of("text"))).cast("long").alias(size),
                    draw_order(F.col("doc_id")).alias(draw))
    d = assign(d, p, (s_size, target, whole, extra), (key, source, size, draw))
    # Repetitions: the whole ones, then one of `extra` words if there are any.
    repeats = F.col(whole) + F.when(F.col(extra) > 0, 1).otherwise(0)
    d = d.withColumn(times, repeats.cast("int")).where(F.col(times) > 0)
    d = d.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    cut = (F.col(copy) > F.col(whole)) & (F.col(extra) < F.col(size))
    words = F.slice(words_of(text_of("text")), F.lit(1), F.col(extra).cast("int"))
    d = d.withColumn("text", F.when(cut, F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS tw,
         coalesce(sum(3 * source_size) OVER before, 0) AS bc, coalesce(sum(w) OVER before, 0) AS bw
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size * (tw - bw) <= (t - bc) * w AS full_up FROM c),
g AS (SELECT *, t - coalesce(sum(3 * source_size) FILTER (full_up) OVER (), 0) AS free_size,
             tw - coalesce(sum(w) FILTER (full_up) OVER (), 0) AS free_weight FROM f),
p AS (SELECT source, source_size,
             CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE)
                  ELSE CAST(free_size * w AS DOUBLE) / CAST(free_weight AS DOUBLE) END AS target FROM g),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM p),
r AS (SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS rest FROM q),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT o.doc_id, o.size, r.source_size, r.target,
       CAST(r.whole * o.size + greatest(0, least(o.size, r.rest - o.before)) AS BIGINT) AS taken
FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source
"""
