"""Packing documents into fixed-length sequences by the sum-of-squares rule.

Texts become token ids (plus one closing id). Only documents longer than a
sequence are cut, into full pieces and one last piece. Full pieces are
sequences of their own; every other piece goes where the sum over residual
gaps of the squared number of open sequences with that gap becomes smallest
(a new sequence counts as one of the places; ties go to the smaller gap).

Tokenizing is a narrow pass that writes one small row per piece. The pieces
are then dealt evenly into groups of about ``GROUP`` and each group is packed
by one task, in a seeded order with the shortest pieces last, with state of
one counter per gap; a group leaves few sequences partly filled.

Defined cases: null or empty text is the closing id alone; null and repeated
ids are rows like others (each row is packed); very long texts are cut into
full pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import text_of
from panelcast.session import materialize

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces per packing task.
GROUP = 50_000
#: Share of a group's pieces, the shortest ones, that are placed after the others.
SHORT_LAST = 0.15
#: Entries of a worker's word cache; it is emptied when full.
CACHE = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Little-endian id bytes of white-space separated chunks, computed when missing.

    Splitting at white space is exact for this tokenizer: its normalizer and
    its pre-tokenizer never join characters across white space. Chunks of
    plain Latin letters, digits and ASCII marks are split as its
    pre-tokenizer does and go to the model directly; others are encoded whole.
    """

    LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    MARKS = r"!-&(-/:-@\[-`{-~"
    PLAIN = re.compile(f"[{LETTERS}0-9{MARKS}]+")
    PARTS = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.parts: dict[str, bytes] = {}
        letters = ByteLevel.alphabet()
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        own = [b for b in range(256) if chr(b) in letters]
        rest = [b for b in range(256) if chr(b) not in letters]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def part(self, word: str) -> bytes:
        got = self.parts.get(word)
        if got is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            seen = word.encode().decode("latin-1").translate(self.letters)
            got = _packed([t.id for t in self.model.tokenize(seen)])
            self.parts[word] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if self.PLAIN.fullmatch(chunk) and "<|" not in chunk:
            got = b"".join([self.part(x) for x in self.PARTS.findall(chunk.lower())])
        else:
            got = self.whole(chunk)
        self[chunk] = got
        return got

    def whole(self, text: str) -> bytes:
        return _packed(self.full.encode(text, add_special_tokens=False).ids)

    #: White space for str.split(), but not for the tokenizer.
    ODD = re.compile("[\x1c-\x1f]")

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
              capacity: int = CAPACITY, closing: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece, written once and numbered (``slot``); ``with_ids`` adds
    the ids as little-endian bytes (``ids``)."""
    tail = _packed([closing])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = WordIds(tokenizer)
        for b in batches:
            rows = []
            for doc, body in zip(b["key"], b["text"]):
                data = ids_of.encode(body) + tail
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = data[4 * start:4 * (start + capacity)]
                    rows.append((None if pd.isna(doc) else int(doc), piece, start, len(part) // 4,
                                 zlib.crc32(part), *([part] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    pieces = rows.mapInPandas(run, PIECES + (", ids binary" if with_ids else ""))
    return materialize(pieces.withColumn("slot", F.monotonically_increasing_id()), "pack-pieces")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, in the order given; lengths are 1 to ``capacity``."""
    # twice[g]: twice the open bins with gap g, plus 1; at 0 nothing, as a full bin does not count.
    twice = np.ones(capacity + 1)
    twice[0] = 0.0
    leave = np.full(capacity + 1, np.inf)  # 1 - 2 * N[g], or inf where there is no such bin
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        change = leave[size:capacity] + twice[:capacity - size]
        best = int(change.argmin()) if size < capacity else 0
        if size < capacity and change[best] <= twice[capacity - size]:
            gap = size + best
            target = open_bins[gap].pop()
            left = len(open_bins[gap])
            twice[gap] = 2 * left + 1
            leave[gap] = 1 - 2 * left if left else np.inf
        else:
            gap, target, made = capacity, made, made + 1
        bins[k], offsets[k] = target, capacity - gap
        rest = gap - size
        if rest:
            open_bins[rest].append(target)
            n = len(open_bins[rest])
            twice[rest] = 2 * n + 1
            leave[rest] = 1 - 2 * n
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` of :func:`tokenized` with ``sequence_id`` and ``offset``."""
    pieces = pieces.drop("ids")
    part = F.col("length") < capacity
    n = pieces.where(part).count()
    groups = max(1, -(-n // group))
    full = (pieces.where(~part)
            .withColumn("sequence_id", F.col("slot") * 2)
            .withColumn("offset", F.lit(0).cast("long")))

    def place(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        # Seeded order, but the shortest pieces come last to fill the gaps that are left.
        b = b.sort_values("slot").sample(frac=1, random_state=int(key[0]))
        b = b.iloc[np.argsort(b["length"].to_numpy() <= b["length"].quantile(SHORT_LAST), kind="stable")]
        bins, offsets = sum_of_squares(b["length"].to_numpy(), capacity)
        return b.drop(columns="grp").assign(sequence_id=(bins * groups + int(key[0])) * 2 + 1, offset=offsets)

    schema = f"{PIECES}, slot long, sequence_id long, offset long"
    rest = (pieces.where(part).withColumn("grp", F.pmod(F.xxhash64("slot"), F.lit(groups)).cast("int"))
            .groupBy("grp").applyInPandas(place, schema))
    return full.unionByName(rest)


def sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and ``ids`` (little-endian bytes)."""
    at = placed.select("slot", "sequence_id", "offset")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # At most ``capacity`` pieces of at least one id share a sequence.
    return (pieces_with_ids.join(at, "slot").groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per piece with its sequence and place."""
    return pack(tokenized(docs, default_tokenizer())).drop("slot")
