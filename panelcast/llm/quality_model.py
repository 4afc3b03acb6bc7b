"""Quality scores from random Fourier features, ridge regression and isotonic calibration.

Statistics of a document (computed by Spark functions in one row-wise pass
over whole texts, written as a narrow table) are standardised and mapped to
``FEATURES`` random Fourier features, which approximate a Gaussian kernel.
Each share of the training rows sums its part of the normal equations; the
sums add up to one small system, solved for the ridge weights. For the
calibration every row is scored by the system without its own share's part, so
by weights that have not seen it; isotonic regression makes these scores a
monotone map to probabilities. The same at every size.

Labels are learned from at most about ``MAX_TRAIN`` labelled rows (chosen by a
hash of the id); this is the only bound, and every document is scored. Scores
never use the label, language, source or id of a document.

Defined cases: null and empty texts have all statistics 0 and a score like
any other; labelled rows of a single share are calibrated to their mean; without labelled rows every score is 0.5; null labels are not
learned from, repeated labels each count; repeated rows and null ids are rows of
their own; ties of scores stay ties; very long texts are measured whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import pinned, text_of, words_of
from panelcast.session import materialize

MAX_TRAIN = 200_000
FEATURES = 192
BANDWIDTH = 2.0
RIDGE = 1e-2
SHARES = 8
SEED = 11
#: Weight of the raw score that keeps order within a calibrated step.
TIE = 1e-3

STATS = ("log_words", "mean_word", "distinct_words", "distinct_pairs", "dup_lines", "words_per_line",
         "symbols", "marks", "upper", "digits", "exclaim", "bars")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics...) of every row."""
    body, w, lines = text_of(text), F.col("w"), F.col("lines")
    d = docs.select(F.col(f"`{key}`").alias("key"), body.alias("text"), pinned(words_of(body)).alias("w"),
                    pinned(F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x)) > 0)).alias("lines"))
    n, chars = F.greatest(F.size(w), F.lit(1)), F.greatest(F.length("text"), F.lit(1))
    pairs = F.when(F.size(w) > 1, F.size(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))))).otherwise(0)

    def share(pattern: str) -> Column:
        return F.regexp_count("text", F.lit(pattern)) / chars

    n_lines = F.greatest(F.size(lines), F.lit(1))
    values = {
        "log_words": F.log1p(F.size(w)),
        "mean_word": F.least(F.length(F.array_join(w, "")) / n, F.lit(40.0)),
        "distinct_words": F.size(F.array_distinct(w)) / n,
        "distinct_pairs": pairs / n,
        "dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / n_lines,
        "words_per_line": F.log1p(F.size(w) / n_lines),
        "symbols": share(r"[#*$%&<>@~^]"),
        "marks": share(r"[.,;:?]"),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "exclaim": share(r"!"),
        "bars": share(r"[|]"),
    }
    return d.select("key", *[values[s].cast("double").alias(s) for s in STATS])


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(self, x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        p = np.interp(raw, *self.steps)
        return np.clip((1 - TIE) * p + TIE / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fourier(m: Model, x: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standardised rows, plus a constant."""
    z = np.clip((x - m.mean) / m.scale, -6, 6)
    f = np.sqrt(2 / m.omega.shape[1]) * np.cos(z @ m.omega + m.phase)
    return np.concatenate([f, np.ones((len(f), 1))], axis=1)


def _equations(m: Model):
    """Sums one share's part of the normal equations."""
    def run(share: pd.DataFrame) -> pd.DataFrame:
        share = share.sort_values(["u", "y", *STATS])
        f = fourier(m, share[list(STATS)].to_numpy())
        part = np.concatenate([(f.T @ f).ravel(), f.T @ share["y"].to_numpy(float)])
        return pd.DataFrame({"share": share["share"].iloc[:1], "sums": [part.tobytes()]})

    return run


def fit(stats: DataFrame, labels: DataFrame, known: Column, label: str = "quality") -> Model | None:
    """The model of the labelled rows where ``known`` holds (a condition on ``key``)."""
    rows = (labels.where(F.col(label).isNotNull())
            .select(F.col("doc_id").alias("key"), F.col(label).cast("double").alias("y")).where(known)
            .join(stats, "key"))
    spread = 1_000_000
    u = F.pmod(F.xxhash64(F.lit("rff"), F.col("key").cast("string")), F.lit(spread))
    rows = materialize(rows.withColumn("u", u), "quality-rows")
    n = rows.count()
    if n == 0:
        return None
    rows = (rows.where(F.col("u") < F.lit(min(spread, spread * MAX_TRAIN // n + 1)))
            .withColumn("share", F.pmod("u", F.lit(SHARES)).cast("int")))

    moments = rows.agg(*[f(s) for s in STATS for f in (F.mean, F.stddev_pop)]).first()
    mean = np.array([moments[2 * i] or 0.0 for i in range(len(STATS))])
    scale = np.array([moments[2 * i + 1] or 1.0 for i in range(len(STATS))])
    rng = np.random.default_rng(SEED)
    m = Model(mean, scale, rng.normal(0, 1 / BANDWIDTH, (len(STATS), FEATURES)),
              rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1)))
    parts = rows.groupBy("share").applyInPandas(_equations(m), "share int, sums binary").collect()  # SHARES rows
    sums = {p.share: np.frombuffer(p.sums) for p in sorted(parts, key=lambda p: p.share)}
    total = sum(sums.values())
    m.weights = solved(total)
    unseen = {share: solved(total - part) for share, part in sums.items()}

    raw = rows.mapInPandas(_raw(m, unseen), "raw double, y double")
    steps = IsotonicRegression(featuresCol="raw", labelCol="y").fit(raw)
    m.steps = (steps.boundaries.toArray(), steps.predictions.toArray())
    return m


def solved(sums: np.ndarray) -> np.ndarray:
    """The ridge weights of summed normal equations."""
    size = FEATURES + 1
    return np.linalg.solve(sums[:size * size].reshape(size, size) + RIDGE * np.eye(size), sums[size * size:])


def _raw(m: Model, unseen: dict[int, np.ndarray]):
    """Raw scores of the training rows by the weights that were fitted without their share."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            weights = np.stack([unseen[share] for share in b["share"]]) if len(b) else np.zeros((0, FEATURES + 1))
            yield pd.DataFrame({"raw": (fourier(m, b[list(STATS)].to_numpy()) * weights).sum(axis=1), "y": b["y"]})

    return run


def predict(stats: DataFrame, m: Model | None) -> DataFrame:
    """(key, score) of every row."""
    if m is None:
        return stats.select("key", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"].astype("Int64"),
                                "score": np.round(m.score(b[list(STATS)].to_numpy()), 9)})

    return stats.mapInPandas(run, "key long, score double")


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held out or not, score and prediction."""
    out = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % 3 == 1
    stats = materialize(statistics(docs), "quality-stats")
    return predict(stats, fit(stats, labels, ~out)).select(
        F.col("key").alias("doc_id"), out.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
