"""Cross-tokenizer alignment of each distinct text, weighted by its copies.

Texts are shuffled by the full text, so that exact copies meet (combined
before the shuffle, a text with very many copies is one row per map task) and
every distinct text is tokenized and aligned once. Both tokenizers' tokens
cover the bytes of space + text; the places where tokens of both end cut them
into groups, and the segments between neighbouring token ends of either
tokenizer are the links: each segment lies in exactly one token of A and one
of B, and two tokens that overlap share exactly one segment.

Each aligned text is written once with its distinct linked id pairs and how
often it links them. A pair's count is the number of documents that hold it:
tasks add up the copies of their texts per pair and emit one row per pair and
task. For the measures that need counts, pairs that at least 1/``COMMON``
of all (text, pair) rows have, so at most ``COMMON`` pairs, travel to all
tasks as sorted arrays and are looked up there; the rest is shuffled and
joined by pair, where none of them weighs on a task. Results go back to the
documents by the text's SHA-256, again with the common keys broadcast.

Defined cases: a text that is null, empty or not covered by the joined bytes
of either tokenizer's tokens (a normalizing tokenizer changed it) has no
tokens: all numbers are 0 and the digest is empty. Special tokens' strings
in a text are plain text. Every row is a document, so rows that repeat an id
or a text count once each; null ids are carried along; of ties for the
highest count of an A id, all are best; very long texts are processed whole;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import join_counted, text_of
from panelcast.session import materialize

#: Pairs with at least this share (as 1/COMMON) of all (text, pair) rows are looked up in the tasks.
COMMON = 1 << 18
#: Pair entries that a task holds before it adds them up, and distinct ones before it emits them.
HELD = 2_000_000
#: Characters of the texts that are aligned at once.
TOGETHER = 4_000_000

ALIGNED = ("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs binary, times binary")
NONE = np.empty(0, np.int64)
ZEROS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class ByteTokens:
    """Byte-level tokenizer of a ``tokenizers`` file: ids and their bytes.

    Its own vocabulary also serves as rank table of the faster ``tiktoken``;
    that is used for texts of Latin characters, for which both split alike,
    and the library of the file for all others.
    """

    OTHER = re.compile("[^\x00-ɏ]")

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file["added_tokens"]}
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        letters = ByteLevel.alphabet()
        own = [b for b in range(256) if chr(b) in letters]
        rest = [b for b in range(256) if chr(b) not in letters]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in entry): i for entry, i in file["model"]["vocab"].items() if entry not in special}
        self.bytes = [b""] * (max(file["model"]["vocab"].values()) + 1)
        for data, i in ranks.items():
            self.bytes[i] = data
        self.fast = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = " Ünïted  <|endoftext|>\n\t it's 2024½, naïve text…!".replace("…", "...")
        if self.fast.encode_ordinary(probe) != self.full.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} does not split text as expected")

    def ids(self, text: str) -> list[int]:
        if self.OTHER.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """Sentencepiece tokenizer with byte fallback: ids and their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.full = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.full.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.full.id_to_piece(list(range(self.full.get_piece_size()))))]

    def ids(self, text: str) -> list[int]:
        return self.full.encode(text, num_threads=1)


class Aligner:
    """Tokens, groups and links of texts under two tokenizers; many texts share each array step.

    Even texts (no space at an end or next to other white space) are put
    together from their words. No token of A reaches across such a single space
    (its pattern takes a space only at the start of a word), and none of B does
    if no piece has a space mark after another character, so both tokenizers cut
    there and each distinct word of a batch is aligned once. All other texts are
    aligned whole.
    """

    UNEVEN = re.compile(r"^\s|\s$|\s\x20|\x20\s")

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.width = len(self.b.bytes)
        self.by_word = not any(re.search(rb"[^\x20]\x20", x) for x in self.b.bytes)
        self.tables = []
        for tokens in (self.a, self.b):
            size = np.array([len(x) for x in tokens.bytes])
            self.tables.append((size, np.cumsum(size) - size, np.frombuffer(b"".join(tokens.bytes), np.uint8)))
        digits = np.array([str(i) for i in range(max(len(self.a.bytes), self.width))], dtype="S8")
        self.n_digits, self.digits = np.char.str_len(digits), digits.view(np.uint8).reshape(len(digits), 8)

    def texts(self, texts: list[str]) -> Iterator[tuple | None]:
        """Per text (n_a, n_b, n_groups, n_links, digest, pairs, times), or None without tokens."""
        even = [self.by_word and bool(t) and not self.UNEVEN.search(t) and not self.a.OTHER.search(t) for t in texts]
        together = self.from_words([t for t, e in zip(texts, even) if e]) if any(even) else iter(())
        for t, e in zip(texts, even):
            if e and together:
                yield next(together)
                continue
            ids = self.ids(t) if t else None
            if not ids or not self.covered([ids]):
                yield None
                continue
            (upto,), form, links = self.align([ids])
            yield self.result(upto[:3], form[:-1], links)

    def result(self, sizes, form: np.ndarray, links: np.ndarray) -> tuple:
        pairs, times = np.unique(links, return_counts=True)
        return *map(int, sizes), len(links), hashlib.sha256(form.tobytes()).hexdigest(), pairs, times

    def ids(self, text: str) -> tuple:
        return np.array(self.a.ids(" " + text)), np.array(self.b.ids(text)), (" " + text).encode()

    def from_words(self, texts: list[str]) -> Iterator[tuple] | None:
        """The results of even texts; None if a word's bytes are not covered."""
        words = " ".join(texts).split(" ")
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        parts, size, first = [], 0, 0
        for i, w in enumerate(distinct.tolist()):
            size += len(w)
            if size > 50_000 or i + 1 == len(distinct):
                parts.append(self.ids(" ".join(distinct[first:i + 1])))
                size, first = 0, i + 1
        if not self.covered(parts):
            return None
        return self._put_together(texts, codes, *self.align(parts, words=True))

    def _put_together(self, texts, codes, upto, form, links) -> Iterator[tuple]:
        sizes = np.diff(upto, axis=0, prepend=0)  # of each word
        at_form, at_links = (upto - sizes)[:, 3], (upto - sizes)[:, 4]
        done = 0
        for t in texts:
            n = t.count(" ") + 1
            own = codes[done:done + n]
            done += n
            mine = sizes[own]
            yield self.result(mine[:, :3].sum(axis=0), form[_spread(at_form[own], mine[:, 3])][:-1],
                              links[_spread(at_links[own], mine[:, 4])])

    def covered(self, ids: list[tuple]) -> bool:
        """Whether the joined bytes of the tokens are those of the texts."""
        data = np.frombuffer(b"".join(x[2] for x in ids), np.uint8)
        for k, (size, start, flat) in enumerate(self.tables):
            every = np.concatenate([x[k] for x in ids])
            length = size[every]
            if length.sum() != len(data):
                return False
            at = np.arange(len(data)) + np.repeat(start[every] - np.cumsum(length) + length, length)
            if not np.array_equal(flat[at], data):
                return False
        return True

    def align(self, ids: list[tuple], words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(upto, form, links) of covered texts one after the other: listing and links of all, and
        what there is of n_a, n_b, n_groups, listing and links up to the end of each text (or word)."""
        a, b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
        end_a, end_b = (np.cumsum(self.tables[k][0][x]) - 1 for k, x in ((0, a), (1, b)))
        # Marks at the bytes where tokens end; a token's number is the number of ends before it.
        ends_a, ends_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        ends_a[end_a] = ends_b[end_b] = True
        cut = ends_a & ends_b
        done_a, done_b, done = (np.cumsum(x, dtype=np.int32) for x in (ends_a, ends_b, cut))
        ends, cuts = np.flatnonzero(ends_a | ends_b), np.flatnonzero(cut)
        links = a[done_a[ends] - ends_a[ends]] * self.width + b[done_b[ends] - ends_b[ends]]
        form, stop = self.listing(a, b, done[end_a] - cut[end_a], done[end_b] - cut[end_b], done_a[cuts], done_b[cuts])
        if words:
            data = np.frombuffer(b"".join(x[2] for x in ids), np.uint8)
            last = np.append(np.flatnonzero(data == 32)[1:], len(data)) - 1
        else:
            last = np.cumsum([len(x[2]) for x in ids]) - 1
        upto = np.stack([done_a[last], done_b[last], done[last], stop[done[last] - 1], np.searchsorted(ends, last) + 1], axis=1)
        return upto, form, links

    def listing(self, a, b, group_a, group_b, upto_a, upto_b) -> tuple[np.ndarray, np.ndarray]:
        """The groups' ids in text form, `a1,a2|b1;a3|b2,b3;`, and where each group ends in it."""
        place_a = np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]
        place_b = np.arange(len(b)) + upto_a[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[upto_a - 1]], mark[place_b[upto_b - 1]] = ord("|"), ord(";")
        form, at = self.digits[ids], self.n_digits[ids]
        form[np.arange(len(ids)), at] = mark
        return form[np.arange(form.shape[1]) <= at[:, None]], np.cumsum(at + 1)[place_b[upto_b - 1]]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one run after the other."""
    upto = np.cumsum(size)
    return np.arange(upto[-1]) + np.repeat(start - upto + size, size)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``TOGETHER`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _pack(numbers: np.ndarray) -> bytes:
    """Rising or small numbers as compressed steps."""
    steps = np.diff(numbers, prepend=0)
    kind = "<i4" if len(steps) == 0 or np.abs(steps).max() < 2 ** 31 else "<i8"
    return kind[1:].encode() + zlib.compress(steps.astype(kind).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data[2:]), "<" + data[:2].decode()), dtype=np.int64)


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """One written row per distinct text that is not empty (columns ``ALIGNED``)."""
    distinct = (docs.select(F.col(f"`{text}`").alias("text")).where("text <> ''")
                .groupBy("text").agg(F.count(F.lit(1)).alias("copies")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(a_path, b_path)
        for b in batches:
            rows = []
            found = (x for part in _batches(b["text"].tolist()) for x in aligner.texts(part))
            for body, copies, got in zip(b["text"], b["copies"], found):
                got = got or (0, 0, 0, 0, "", NONE, NONE)
                rows.append((hashlib.sha256(body.encode()).digest(), copies, *got[:5], _pack(got[5]), _pack(got[6])))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ALIGNED.split(", ")])

    return materialize(distinct.mapInPandas(run, ALIGNED), "align-texts")


def pair_counts(texts: DataFrame, width: int) -> DataFrame:
    """(pair, texts, docs, best): written; ``texts`` and ``docs`` hold the pair, ``best`` if no
    other pair of its A id has more documents. ``pair`` is A id * ``width`` + B id."""
    def add_up(parts: list[tuple]) -> tuple:
        pairs, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([p[i] for p in parts]), len(pairs)).astype(np.int64) for i in (1, 2)]
        return pairs, *sums

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for b in batches:
            for data, copies in zip(b["pairs"], b["copies"]):
                pairs = _unpack(data)
                parts.append((pairs, np.ones(len(pairs), np.int64), np.full(len(pairs), copies)))
                held += len(pairs)
                if held > HELD:
                    parts = [add_up(parts)]
                    held = len(parts[0][0])
                    if 2 * held > HELD:
                        yield pd.DataFrame(dict(zip(("pair", "texts", "docs"), parts[0])))
                        parts, held = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("pair", "texts", "docs"), add_up(parts))))

    sums = (texts.select("pairs", "copies").mapInPandas(run, "pair long, texts long, docs long")
            .groupBy("pair").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs")))
    sums = sums.withColumn("a", F.expr(f"pair div {width}"))
    # An A id has at most `width` pairs, whatever the corpus; its highest count is one combined row.
    top = sums.groupBy("a").agg(F.max("docs").alias("top"))
    return materialize(sums.join(top.hint("shuffle_hash"), "a")
                       .select("pair", "texts", "docs", (F.col("docs") == F.col("top")).alias("best")), "align-pairs")


def counted(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of every aligned text; written."""
    spark = texts.sparkSession
    total = counts.agg(F.sum("texts")).first()[0] or 0
    common = counts.where(F.col("texts") * COMMON >= total).select("pair", "docs", "best").toPandas().sort_values("pair")
    held = spark.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["docs"].to_numpy(np.int64),
                                         common["best"].to_numpy(bool)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, docs, best = held.value
        for b in batches:
            rows = []
            for key, data, often in zip(b["key"], b["pairs"], b["times"]):
                pairs, times = _unpack(data), _unpack(often)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                at, sure = at[hit], times[hit]
                rows.append((key, int(sure[best[at]].sum()), int((sure * docs[at]).sum()), pairs[~hit], times[~hit]))
            yield pd.DataFrame(rows, columns=["key", "n_best", "count_sum", "pairs", "times"])

    part = materialize(texts.select("key", "pairs", "times").mapInPandas(
        run, "key binary, n_best long, count_sum long, pairs array<long>, times array<long>"), "align-common")
    rare = (part.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")))
    rare = rare.join(counts.where(F.col("texts") * COMMON < total).select("pair", "docs", "best").hint("shuffle_hash"), "pair")
    late = rare.select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
                       (F.col("times") * F.col("docs")).alias("count_sum"))
    return (part.select("key", "n_best", "count_sum").unionByName(late)
            .groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def measures(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and the alignment measures of its text."""
    texts = aligned(docs, a_path, b_path, text)
    numbers = counted(texts, pair_counts(texts, len(PieceTokens(b_path).bytes)))
    found = materialize(texts.drop("pairs", "times").join(numbers, "key"), "align-measures")
    total = found.agg(F.sum("copies")).first()[0] or 0
    body = text_of(text)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text"))
    empty = rows.where("text = ''").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ZEROS],
                                           F.lit("").alias("groups_sha256"))
    rows = rows.where("text <> ''").select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    return join_counted(rows, found, "key", "copies", total).select(empty.columns).unionByName(empty)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Alignment of the public byte-level and piece tokenizers over all documents."""
    import public_tokenizers

    return measures(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
