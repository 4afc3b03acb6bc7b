"""Language identification by a linear-chain conditional random field over words.

Every run of letters is a word; a run of more than ``WIDTH`` letters (text without
spaces) is split into consecutive words of at most ``WIDTH``, in training as in
scoring, so that every letter takes part. Every word of a text gets a posterior over the learned languages by
forward-backward; a text's language is the one with the largest posterior sum
over all its words, and the score is its share. Emissions are sums of learned
weights of hashed affixes (1 to 4 letters), letter n-grams (2 and 3) and
lexicon membership; transitions and the start are learned too, so a passage in
another language inside a text is labelled as such and does not flip the rest.

Training uses a bounded sample of labelled documents (``TRAIN_DOCS`` per
language, chosen by a hash of the id), whose words take the document's
language. Each round every task runs the field over its share of the sample
from the common weights, and the weights are averaged (iterative parameter
mixing); the shares are a fixed, written table of ``SHARES`` partitions.

Scoring is one row-wise pass over whole texts: word emissions are computed
once per distinct word of a worker (a bounded cache), and texts of a batch are
run through the chain in lockstep.

Defined cases: null text, and text without a letter, is ``und`` with score 0;
without any labelled training text every text is ``und``; null languages are
not learned from; repeated rows and ids are rows of their own; very long
texts are processed whole; of languages with equal shares the first by name is
taken; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import text_of
from panelcast.session import materialize

#: Bound of the training sample: documents per language.
TRAIN_DOCS = 500
LEXICON = 1500
SHARES = 6
ROUNDS = 3
EPOCHS = 2
BUCKETS = 1 << 15
WIDTH = 24
SEGMENT = 40
#: One training segment in so many is repeated with an end in another language.
SWITCH = 8
#: Words of a worker's emission cache, and words that go through the chain together.
CACHE = 300_000
CHAIN_WORDS = 1_000_000
UNKNOWN = "und"

# A letter is what Unicode calls one (categories L*), as in Spark's \p{L}: a word character
# but digits, "_" and the other numbers (such as fractions and Roman numerals), which are blanked first.
_NUMBERS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")]
# Two classes: one with characters above U+FFFF is searched one by one, which would slow down all texts.
NUMBER = re.compile(f"[{''.join(c for c in _NUMBERS if c <= chr(0xFFFF))}]")
HIGH = re.compile(f"[{chr(0x10000)}-{chr(sys.maxunicode)}]")
HIGH_NUMBER = re.compile(f"[{''.join(c for c in _NUMBERS if c > chr(0xFFFF))}]")
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
PIECE = re.compile(rf"[^\W\d_]{{1,{WIDTH}}}")


@dataclass
class Field:
    """Weights of the random field; ``emit`` has the buckets, a padding row of zeros and one row per lexicon."""

    langs: list[str]
    lexicon: dict[str, list[int]]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def blanked(text: str) -> str:
    """The text with its number characters as spaces (digits are none of words anyway)."""
    text = NUMBER.sub(" ", text)
    return HIGH_NUMBER.sub(" ", text) if HIGH.search(text) else text


def letters_of(chunk: str) -> str:
    """The letters of a white-space separated chunk, in lower case."""
    return "".join(WORD.findall(blanked(chunk))).lower()


def pieces_of(text: str) -> list[str]:
    """The words of the chain: runs of letters, in lower case, in pieces of at most ``WIDTH``."""
    return PIECE.findall(blanked(text.lower()))


def features(words: list[str], lexicon: dict[str, list[int]], langs: int) -> np.ndarray:
    """Rows of ``emit`` that are active for each word (padded)."""
    pad = BUCKETS
    n = len(words)
    length = np.array([len(w) for w in words])
    width = max(WIDTH, length.max(initial=0))
    codes = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(n, width).astype(np.uint64)
    out = []

    def add(kind: int, at: np.ndarray, size: int) -> None:
        """The hash of ``size`` letters from column ``at`` of every row."""
        ok = (at >= 0) & (at + size <= length[:, None])
        h = np.full(at.shape, kind * 1_000_003, np.uint64)
        rows = np.arange(n)[:, None]
        for k in range(size):
            h = (h ^ codes[rows, np.clip(at + k, 0, width - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(np.where(ok, (h % np.uint64(BUCKETS)).astype(np.int64), pad))

    for size in (1, 2, 3, 4):
        add(size, np.zeros((n, 1), np.int64), size)
        add(10 + size, (length - size)[:, None], size)
    for size in (2, 3):
        add(20 + size, np.broadcast_to(np.arange(width - size + 1), (n, width - size + 1)), size)
    known = np.full((n, langs), pad, np.int64)
    for i, w in enumerate(words):
        for lang in lexicon.get(w, ()):
            known[i, lang] = pad + 1 + lang
    return np.concatenate([*out, known], axis=1)


def emissions(field: Field, words: list[str]) -> np.ndarray:
    """Positive emission factors of the words, scaled to a largest of 1."""
    if not words:
        return np.empty((0, len(field.langs)), np.float32)
    score = field.emit[features(words, field.lexicon, len(field.langs))].sum(axis=1)
    return np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32)


def posteriors(emit: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Forward-backward of equally long chains; ``emit`` is (chains, steps, langs).

    Returns node posteriors and the summed transition posteriors.
    """
    chains, steps, langs = emit.shape
    ahead = np.empty_like(emit)
    a = start * emit[:, 0]
    ahead[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (ahead[:, t - 1] @ move) * emit[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    node = np.empty_like(emit)
    node[:, -1] = ahead[:, -1]
    pairs = np.zeros((langs, langs))
    back = np.ones((chains, langs))
    for t in range(steps - 1, 0, -1):
        seen = emit[:, t] * back
        joint = ahead[:, t - 1][:, :, None] * move * seen[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = seen @ move.T
        back /= back.sum(axis=1, keepdims=True)
        p = ahead[:, t - 1] * back
        node[:, t - 1] = p / p.sum(axis=1, keepdims=True)
    return node, pairs


def text_posteriors(ids: list[np.ndarray], table: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per text (word ids into ``table``), the sum of its words' posteriors.

    The texts go through the chain in lockstep, longest first, so that the ones
    still running are a leading slice at every step.
    """
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    lengths = np.array([len(ids[i]) for i in order])
    steps = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than step t
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([ids[i] for i in order])
    first = np.concatenate([[0], np.cumsum(live)])
    ahead = np.empty((len(flat), table.shape[1]), np.float32)
    a = start.astype(np.float32) * table[flat[offset]]
    ahead[:len(order)] = a / a.sum(axis=1, keepdims=True)
    move = move.astype(np.float32)
    for t in range(1, steps):
        n = live[t]
        a = (ahead[first[t - 1]:first[t - 1] + n] @ move) * table[flat[offset[:n] + t]]
        ahead[first[t]:first[t] + n] = a / a.sum(axis=1, keepdims=True)
    total = np.zeros((len(order), table.shape[1]))
    back = np.ones((len(order), table.shape[1]), np.float32)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        p = ahead[first[t]:first[t] + n] * back[:n]
        total[:n] += p / p.sum(axis=1, keepdims=True)
        if t:
            b = (table[flat[offset[:n] + t]] * back[:n]) @ move.T
            back[:n] = b / b.sum(axis=1, keepdims=True)
    out = np.empty_like(total)
    out[order] = total
    return out


def _joined(segments: list[tuple[np.ndarray, np.ndarray]], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Segments that switch: the start of one and the end of another of a different language,
    one for every ``SWITCH`` segments."""
    rng = np.random.default_rng(1000 + seed)
    whole = [s for s in segments if len(s[0]) == SEGMENT]
    out = []
    for i in rng.permutation(len(whole))[:len(whole) // SWITCH]:
        j, cut = rng.integers(len(whole)), rng.integers(SEGMENT // 4, SEGMENT - SEGMENT // 4)
        if whole[i][1][0] != whole[j][1][0]:
            out.append(tuple(np.concatenate([whole[i][k][:cut], whole[j][k][cut:]]) for k in (0, 1)))
    return out


def _epochs(field: Field, segments: list[tuple[np.ndarray, np.ndarray]], idx: np.ndarray, seed: int,
            rate: float = 0.2, decay: float = 1e-5) -> None:
    """Adagrad over equally long segments of word numbers and the words' languages."""
    langs = len(field.langs)
    rng = np.random.default_rng(seed)
    g_emit, g_move, g_start = (np.full_like(x, 1e-6) for x in (field.emit, field.move, field.start))
    by_length: dict[int, list[int]] = {}
    for i, (ids, _) in enumerate(segments):
        by_length.setdefault(len(ids), []).append(i)
    batches = [b for group in by_length.values() for b in
               np.array_split(rng.permutation(group), max(1, len(group) // 64))]
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            part = [segments[i] for i in batches[b]]
            words = np.stack([ids for ids, _ in part])
            gold = np.stack([lang for _, lang in part])
            active = idx[words]  # chains, steps, features
            score = field.emit[active].sum(axis=2)
            node, pairs = posteriors(np.exp(score - score.max(axis=2, keepdims=True)),
                                     np.exp(field.move), np.exp(field.start))
            want = np.zeros_like(node)
            np.put_along_axis(want, gold[:, :, None], 1, axis=2)
            d = (node - want).reshape(-1, langs) / len(part)
            flat = active.reshape(len(d), -1)
            grad = np.stack([np.bincount(flat.ravel(), np.repeat(d[:, c], flat.shape[1]), len(field.emit))
                             for c in range(langs)], axis=1) + decay * field.emit
            moves = np.bincount((gold[:, :-1] * langs + gold[:, 1:]).ravel(), minlength=langs * langs)
            d_move = (pairs - moves.reshape(langs, langs)) / len(part) + 0.05 * field.move
            d_start = (node[:, 0] - want[:, 0]).mean(axis=0) + 0.05 * field.start
            for w, g, x in ((field.emit, g_emit, grad), (field.move, g_move, d_move), (field.start, g_start, d_start)):
                g += x * x
                w -= rate * x / np.sqrt(g)
            field.emit[BUCKETS] = 0


def training_sample(docs: DataFrame, known: Column, key: str = "doc_id", text: str = "text",
                    lang: str = "lang") -> DataFrame:
    """(share, lang, text): at most about ``TRAIN_DOCS`` documents per language, written in ``SHARES`` partitions."""
    rows = docs.where(known & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(f"`{lang}`")).count().collect()}  # one row per language
    spread = 1_000_000
    u = F.pmod(F.xxhash64(F.lit("lid"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(spread))
    cut = F.lit(0)
    for name, n in counts.items():
        cut = F.when(F.col(f"`{lang}`") == name, F.lit(min(spread, int(spread * TRAIN_DOCS / n) + 1))).otherwise(cut)
    picked = rows.where(u < cut).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), u.alias("u"))
    return materialize(picked.withColumn("share", F.pmod("u", F.lit(SHARES)).cast("int")), "lid-sample")


def learn_lexicon(sample: DataFrame, langs: list[str]) -> dict[str, list[int]]:
    """The most frequent words of each language in the sample (``LEXICON`` each)."""
    from pyspark.sql import Window

    words = sample.select("lang", F.explode(
        F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{WIDTH}}}"), F.lit(0))).alias("w"))
    counts = words.groupBy("lang", "w").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))
    top = counts.withColumn("r", rank).where(F.col("r") <= LEXICON).collect()  # bounded by the parameter
    lexicon: dict[str, list[int]] = {}
    for r in top:
        lexicon.setdefault(r.w, []).append(langs.index(r.lang))
    return lexicon


def _trainer(field: Field, step: int):
    """The function that trains a copy of the field on one share of the sample."""
    def run(share: pd.DataFrame) -> pd.DataFrame:
        own = Field(field.langs, field.lexicon, field.emit.copy(), field.move.copy(), field.start.copy())
        seen: dict[str, int] = {}
        segments = []
        for lang, body in sorted(zip(share["lang"], share["text"])):
            ids = np.array([seen.setdefault(w, len(seen)) for w in pieces_of(body)], np.int64)
            gold = np.full(len(ids), field.langs.index(lang))
            segments += [(ids[i:i + SEGMENT], gold[i:i + SEGMENT]) for i in range(0, len(ids), SEGMENT)]
        segments += _joined(segments, step)
        if segments:
            _epochs(own, segments, features(list(seen), field.lexicon, len(field.langs)), step)
        weights = np.concatenate([own.emit.ravel(), own.move.ravel(), own.start])
        return pd.DataFrame({"weights": [weights.tobytes()], "words": [float(sum(len(s) for s, _ in segments))]})

    return run


def fit(docs: DataFrame, known: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Field | None:
    """The field learned from the rows where ``known`` holds; None without any."""
    sample = training_sample(docs, known, key, text, lang)
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    c = len(langs)
    field = Field(langs, learn_lexicon(sample, langs), np.zeros((BUCKETS + 1 + c, c)), np.zeros((c, c)), np.zeros(c))

    for step in range(ROUNDS):
        run = _trainer(field, step)
        parts = sample.groupBy("share").applyInPandas(run, "weights binary, words double").collect()  # SHARES rows
        parts = sorted((p for p in parts if p.words > 0), key=lambda p: p.weights)
        if not parts:
            return None
        total = sum(p.words for p in parts)
        mean = sum(np.frombuffer(p.weights) * (p.words / total) for p in parts)
        e, m = field.emit.size, field.move.size
        field = Field(langs, field.lexicon, mean[:e].reshape(field.emit.shape),
                      mean[e:e + m].reshape(c, c), mean[e + m:])
    return field


class Emissions:
    """Emission rows of the words that a worker has met."""

    def __init__(self, field: Field):
        self.field, self.row = field, {}
        self.table = np.ones((0, len(field.langs)), np.float32)

    def learn(self, words: list[str]) -> np.ndarray:
        """The rows of ``table`` of the (distinct) words."""
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > CACHE:
            new, self.row, self.table = words, {}, self.table[:0]
        self.row.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        parts = [emissions(self.field, new[i:i + 50_000]) for i in range(0, len(new), 50_000)]
        self.table = np.concatenate([self.table, *parts])
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))


def predict(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    if field is None:
        return rows.select("key", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Emissions(field)
        move, start = np.exp(field.move), np.exp(field.start)
        for b in batches:
            pred, score = np.full(len(b), UNKNOWN, object), np.zeros(len(b))
            texts = b["text"].tolist()
            order = sorted((i for i, t in enumerate(texts) if LETTER.search(t)), key=lambda i: len(texts[i]))
            while order:
                # Texts of like length, some CHAIN_WORDS words at once.
                held, ids, n = [], [], 0
                seen: dict[str, int] = {}
                while order and n < CHAIN_WORDS:
                    at = order.pop()
                    words = pieces_of(texts[at])
                    if not words:
                        continue
                    held.append(at)
                    for w in words:
                        seen.setdefault(w, len(seen))
                    ids.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                    n += len(words)
                if not held:
                    continue
                rows_of = known.learn(list(seen))
                ids = [rows_of[x] for x in ids]
                sums = text_posteriors(ids, known.table, move, start)
                best = sums.argmax(axis=1)
                pred[held] = np.array(field.langs, object)[best]
                score[held] = np.round(np.minimum(1.0, sums.max(axis=1) / sums.sum(axis=1)), 6)
            yield pd.DataFrame({"key": b["key"].astype("Int64"), "lang_pred": pred, "score": score})

    return rows.mapInPandas(run, "key long, lang_pred string, score double")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: held out or not, predicted language and its share of the words."""
    out = held_out(F.col("doc_id"), 4, 2)
    field = fit(docs, ~out)
    return predict(docs, field).select(F.col("key").alias("doc_id"), held_out(F.col("key"), 4, 2).alias("held_out"),
                                       "lang_pred", "score")
