"""Near-duplicate classes from DartMinHash signatures.

Signatures. The five-word shingles of a text are a weighted set. Every
element throws darts into its (weight, rank) region: each unit cell of the
region holds a Poisson(1) number of darts, placed by hashing the element and
the cell, so that all texts see the same darts of an element. A dart counts
if it lies below the element's weight, and belongs to one of ``K``
coordinates; a coordinate keeps its earliest dart by rank. Two signatures
agree in a coordinate with the probability of the sets' weighted Jaccard
similarity. Cells are opened by rising rank only until every coordinate has a
dart, so a text costs about ``max(shingles, K ln K)`` darts, not
``shingles * K``.

Classes. Equal texts are one class from the start and go on as one row with a
number of its own, whatever ids they have (the numbers are written once). The
signature is cut into bands; texts that agree in a band share a bucket. In a
bucket, pairs whose whole signatures agree in ``LIKELY`` of the coordinates
or more join into clusters (texts that only share a passage fall apart here);
a cluster's texts are then brought together once and likely pairs are
checked on the exact shingle sets, unless the two are linked already. Both
steps return links of a spanning forest, never all pairs, and a bucket or cluster
larger than ``BLOCK`` is dealt into blocks, whose pairs of blocks are tasks
of their own; the links of all tasks are then joined into classes. Ids come in
at the end only: a class is named by its smallest id, and the document of that
id stays (of two texts with that id, the one with the smaller SHA-256).

With 32 bands of 6 rows a pair of similarity 0.8 shares a bucket with
probability 0.9999, and ``LIKELY`` is more than four standard deviations of
the estimate below 0.8; the exact check keeps pairs of 0.8 or more only.

Defined cases: words are compared in lower case, split at white space; texts
of one to four words have their whole word list as one shingle; null, empty
and wordless texts are classes of their own; repeated rows (same id, same
text) are one document; rows that share an id but not the text are documents
of their own, each judged by its own text; rows with a null id take part like
others, come after all ids, and a class without any id has a null name (two
rows with a null id and the same words are one document); an empty table gives
an empty result; very long texts are compared whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, text_of, words_of
from panelcast.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 6
K = BANDS * ROWS
#: Share of agreeing coordinates from which a pair is checked exactly.
LIKELY = 0.68
#: Texts of one bucket or cluster that meet each other in one task.
BLOCK = 512

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Cumulative Poisson(1) probabilities as thresholds of a 32-bit hash.
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)]) * 2.0 ** 32).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix) of unsigned integers."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the word windows; a short text has one window of all its words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(SHINGLE, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mix(out ^ words[i:n - size + 1 + i])
    return out


def darts(elements: np.ndarray, weights: np.ndarray, cells: range, k: int):
    """(coordinate, rank, identity) of the darts in the rank cells ``cells``."""
    if weights.max() > 1:
        reach = np.ceil(weights).astype(np.int64)
        owner = np.repeat(np.arange(len(elements)), reach)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
    else:
        owner, level = np.arange(len(elements)), np.zeros(len(elements), np.int64)
    cell = np.repeat(np.arange(cells.start, cells.stop, dtype=np.uint64), len(owner))
    owner, level = np.tile(owner, len(cells)), np.tile(level, len(cells))
    seed = mix(mix(elements[owner] ^ cell * _MIX1) ^ level.astype(np.uint64) * _MIX2)
    count = np.searchsorted(_POISSON, seed >> np.uint64(32), side="right")
    src = np.repeat(np.arange(len(seed)), count)
    nth = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
    place = mix(seed[src] + nth.astype(np.uint64) * _STEP)
    spot = mix(place)
    inside = level[src] + (spot >> np.uint64(40)) * 2.0 ** -24 < weights[owner[src]]
    src, place, spot = src[inside], place[inside], spot[inside]
    coord = ((spot & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
    return coord.astype(np.int64), cell[src] + (place >> np.uint64(11)) * 2.0 ** -53, place


def signature(elements: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate, as its hash."""
    sig, open_ = np.zeros(k, np.uint64), np.ones(k, bool)
    # Cells enough to reach every coordinate at the first try, mostly.
    step = max(1, math.ceil(k * (math.log(k) + 1.5) / weights.sum()))
    start = 0
    while open_.any():
        coord, rank, place = darts(elements, weights, range(start, start + step), k)
        new = open_[coord]
        coord, rank, place = coord[new], rank[new], place[new]
        late_first = np.argsort(-rank, kind="stable")
        sig[coord[late_first]] = place[late_first]  # the last one written is the earliest dart
        open_[coord] = False
        start += step
    return sig


def bands_of(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    key = mix(np.arange(bands, dtype=np.uint64))
    for j in range(rows.shape[1]):
        key = mix(key ^ rows[:, j])
    return key.view(np.int64)


def copy_of(text: str) -> Column:
    """The SHA-256 that names an exact text."""
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def word_hashes(text: str) -> Column:
    """Array of the words' 64-bit hashes, made by Spark."""
    return F.transform(words_of(F.lower(text_of(text))), lambda w: F.xxhash64(w))


def weighted(sh: np.ndarray, by_count: bool) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(sh, return_counts=True)
    return elements, counts.astype(float) if by_count else np.ones(len(elements))


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text", by_count: bool = False) -> DataFrame:
    """(key, copy, worded, bands, sketch): copy names the exact text; the sketch has two
    bytes per coordinate; bands and sketch are null without words.

    ``by_count`` weighs a shingle by its occurrences; else each counts 1 (plain
    Jaccard similarity).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bands, sketch = [], []
            for words in b["words"]:
                sh = shingles(np.asarray(words, np.int64).view(np.uint64))
                sig = signature(*weighted(sh, by_count)) if len(sh) else None
                bands.append(None if sig is None else bands_of(sig))
                sketch.append(None if sig is None else sig.astype("<u2").tobytes())
            yield pd.DataFrame({"key": b["key"].astype("Int64"), "copy": b["copy"],
                                "worded": [x is not None for x in bands], "bands": bands, "sketch": sketch})

    rows = docs.select(F.col(f"`{key}`").alias("key"), copy_of(text).alias("copy"), word_hashes(text).alias("words"))
    return rows.mapInPandas(run, "key long, copy binary, worded boolean, bands array<long>, sketch binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of the graph of ``edges`` (a, b); root is the smallest node joined.

    Rounds of large-star and small-star: each node hangs its larger neighbours,
    then its smaller ones, on its smallest neighbour, until nothing changes. Every
    round is written; sums are compared to see the fixed point.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("low"))

    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(smallest(both), "a").where("b > a")
                 .select(F.col("b").alias("a"), F.least("low", "a").alias("b")).where("a <> b").distinct())
        low = smallest(large)
        small = (large.join(low, "a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
                 .unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        k += 1
        e = materialize(small, f"{name}-{k}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def in_buckets(reps: DataFrame) -> DataFrame:
    """(key, grp): the band buckets of two texts or more."""
    member = reps.select("key", F.explode("bands").alias("grp"))  # the hash covers the band's number
    shared = member.groupBy("grp").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    return member.join(shared.select("grp"), "grp")


def work_units(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, grp, own, i, j): the tasks that a text takes part in.

    A group of up to ``block`` texts is one task (0, 0). A larger one is dealt
    into blocks; its tasks are the pairs of blocks, and a text goes to those of its ``own``.
    """
    size = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    d = members.join(size, "grp").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select("key", "grp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _forest(unit: list[tuple], across: bool, threshold: float | None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs that are similar enough.

    ``unit`` holds (key, block, sketch, shingles); ``across`` takes pairs of
    different blocks only (a block's own pairs have a task of their own).
    Without a threshold, likely pairs are linked; with one, they are checked.
    """
    sketch = np.stack([u[2] for u in unit])
    block = np.array([u[1] for u in unit])
    left, right, agree = [], [], []
    for y in range(1, len(unit)):
        n = (sketch[:y] == sketch[y]).sum(axis=1)
        x = np.flatnonzero((n >= LIKELY * K) & ((block[:y] != block[y]) | (not across)))
        left.append(x)
        right.append(np.full(len(x), y))
        agree.append(n[x])
    left, right, agree = map(np.concatenate, (left, right, agree))
    order = np.argsort(-agree, kind="stable")
    parent = list(range(len(unit)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b in zip(left[order].tolist(), right[order].tolist()):
        ra, rb = root(a), root(b)
        if ra == rb:
            continue
        if threshold is not None:
            s, t = unit[a][3], unit[b][3]
            if min(len(s), len(t)) < threshold * max(len(s), len(t)):
                continue
            either = len(np.union1d(s, t))
            if len(s) + len(t) - either < threshold * either:
                continue
        parent[ra] = rb
        links.append((unit[a][0], unit[b][0]))
    return links


def forests(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """(a, b): the links of every unit of ``rows`` (key, grp, own, i, j, sketch and,
    with a threshold, words), each unit in one task."""
    exact = threshold is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, unit, found = None, [], []
        for batch in batches:
            words = batch["words"] if exact else batch["key"]
            for key, name, own, sketch, w in zip(
                    batch["key"], zip(batch["grp"], batch["i"], batch["j"]), batch["own"], batch["sketch"], words):
                if name != now:
                    if len(unit) > 1:
                        found += _forest(unit, now[1] != now[2], threshold)
                    now, unit = name, []
                if unit and unit[-1][0] == key:
                    continue  # a repeated row
                unit.append((key, own, np.frombuffer(sketch, "<u2"), np.unique(
                    shingles(np.asarray(w, np.int64).view(np.uint64))) if exact else None))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
            found = []
        if len(unit) > 1:
            yield pd.DataFrame(_forest(unit, now[1] != now[2], threshold), columns=["a", "b"], dtype="int64")

    names = ["key", "grp", "own", "i", "j", "sketch"]
    dealt = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "key")
    return dealt.select(*names, *([word_hashes("text").alias("words")] if exact else [])).mapInPandas(run, "a long, b long")


def with_roots(joined: DataFrame) -> DataFrame:
    """``joined`` (node, root) and a row for each root itself."""
    return joined.unionByName(joined.select("root").distinct().select(F.col("root").alias("node"), "root"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy, worded, class, kept): per row, the smallest id of its class of near
    duplicates and whether its document is the one that stays."""
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sig = materialize(signed(plain, "key"), "near-signed")
    # Equal texts with words become one row (combined before the shuffle), numbered and written once.
    first = F.struct(F.col("key").isNull().alias("none"), "key", "bands", "sketch")  # null ids last
    reps = materialize(sig.where("worded").groupBy("copy").agg(F.min(first).alias("m"))
                       .select(F.monotonically_increasing_id().alias("node"), "copy", F.col("m.key").alias("low"),
                               "m.bands", "m.sketch"), "near-reps")
    nodes = reps.withColumnRenamed("node", "key")
    sketches = nodes.select("key", "sketch")
    likely = forests(work_units(in_buckets(nodes)).join(sketches, "key"))
    members = with_roots(components(likely, "near-cluster")).select(F.col("node").alias("key"), F.col("root").alias("grp"))
    units = materialize(work_units(members).join(nodes.select("key", "copy", "low", "sketch"), "key"), "near-units")
    # Texts are dealt out by copy and id and meet hash tables of the narrow units; they are not sorted.
    texts = plain.select(F.col("key").alias("id"), "text", copy_of("text").alias("own_copy"))
    dealt = texts.join(units.hint("shuffle_hash"), (F.col("own_copy") == F.col("copy")) & F.col("id").eqNullSafe(F.col("low")))
    joined = with_roots(components(forests(dealt, THRESHOLD), "near-class"))
    # The document that stays, per class of two texts or more; other texts stay for themselves.
    stays = reps.select("node", "low", "copy").join(joined, "node").groupBy("root").agg(
        F.min(F.struct(F.col("low").isNull().alias("none"), "low", "copy")).alias("stays"))
    of_node = joined.join(stays, "root").select("node", "stays")
    alone = F.col("stays").isNull()
    of_copy = reps.select("node", "copy", "low").join(of_node, "node", "left").select(
        "copy", F.when(alone, F.col("low")).otherwise(F.col("stays.low")).alias("class"),
        (alone | (F.col("copy") == F.col("stays.copy"))).alias("first"))
    rows = sig.select("key", "copy", "worded").join(of_copy, "copy", "left")
    return rows.select("key", "copy", "worded", F.when(F.col("worded"), F.col("class")).otherwise(F.col("key")).alias("class"),
                       (~F.col("worded") | (F.col("first") & F.col("key").eqNullSafe(F.col("class")))).alias("kept"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: its class (smallest id in it) and whether it is the one that stays."""
    return classes(docs).select(F.col("key").alias("doc_id"), F.col("class").alias("class_id"), "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, columns unchanged; of rows that share id and text, one."""
    key, copy, own, gone, times = fresh(docs, "near_key", "near_copy", "near_own", "near_gone", "near_times")
    marks = classes(docs).where("worded or key is not null").groupBy(F.col("key").alias(key), F.col("copy").alias(copy)).agg(
        F.max(~F.col("kept")).alias(gone), F.count(F.lit(1)).alias(times))
    marks = materialize(marks.where(F.col(gone) | (F.col(times) > 1)), "near-marks")
    # Texts are dealt out once, by id and copy, the same way at every size.
    left = docs.withColumn(own, copy_of("text")).join(
        marks.hint("shuffle_hash"), (F.col(own) == F.col(copy)) & F.col("doc_id").eqNullSafe(F.col(key)), "left")
    single = left.where(F.col(copy).isNull())
    repeated = left.where(~F.col(gone)).dropDuplicates(["doc_id", own])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
