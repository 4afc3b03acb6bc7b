"""Forecast files for very many series: packed CSV with a manifest of byte ranges.

A folder per series is one file and one directory entry for each of them. Here
rows are dealt out by ranges of (series, date), every task writes one file in
which the rows of a series follow each other, and a manifest says where each
series lies: file, offset, length. A series that crosses tasks has one row per
piece. So the number of files is the number of tasks, and one series is read
by its byte ranges alone.

Every piece is a CSV file of its own (header and rows). The manifest is
written by Spark from what the tasks report and alone says which files
count: a task that was run again leaves at most a file that nothing refers to.
Files are reached through ``pyarrow.fs`` (local, HDFS, S3 and GCS paths).
"""

from __future__ import annotations

import csv
import io
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tasks' functions travel by value: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST_SCHEMA = "code string, file string, offset long, length long, n_rows long, first_dt date"
ROWS_SCHEMA = "code string, dt date, unscale_pred double"
HEADER = "code,dt,unscale_pred\n"
#: Largest byte range of one read, and rows that a task holds before it writes them.
MAX_READ = 8 << 20
HELD_ROWS = 100_000


def _open_fs(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _missing(x) -> bool:
    return x is None or x != x


def _lines(rows: list[tuple]) -> bytes:
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    for code, dt, value in rows:
        # An empty field is null; an empty key is written in quotes.
        cells = ["" if _missing(dt) else dt.isoformat(), "" if _missing(value) else repr(float(value))]
        if code == "":
            out.write('""')
        write.writerow(["" if code in (None, "") else code, *cells])
    return out.getvalue().encode()


def write_packed_csv(df: DataFrame, path: str, key: str = "code", files: int | None = None) -> DataFrame:
    """Write (key, dt, unscale_pred) below ``path``; the manifest.

    ``files`` is the number of files at most (else the session's shuffle partitions).
    """
    data, folder = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/manifest"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(data)
        fs.create_dir(base, recursive=True)
        name, out, offset = f"part-{uuid.uuid4().hex}.csv", None, 0
        piece, held = None, []  # the piece at hand: [code, offset, bytes so far, rows, first date]

        def flush() -> None:
            nonlocal held, offset
            body = _lines(held)
            out.write(body)
            offset, held = offset + len(body), []

        def closed() -> list[tuple]:
            if piece is None:
                return []
            flush()
            return [(piece[0], name, piece[1], offset - piece[1], piece[2], piece[3])]

        try:
            for b in batches:
                found = []
                for code, dt, value in zip(b["code"], b["dt"], b["unscale_pred"]):
                    code = None if _missing(code) else code
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    if piece is None or piece[0] != code:
                        found += closed()
                        piece = [code, offset, 0, None if _missing(dt) else dt]
                        out.write(HEADER.encode())
                        offset += len(HEADER)
                    held.append((code, dt, value))
                    piece[2] += 1
                    if len(held) >= HELD_ROWS:
                        flush()
                yield pd.DataFrame(found, columns=["code", "file", "offset", "length", "n_rows", "first_dt"])
            if piece is not None:
                yield pd.DataFrame(closed(), columns=["code", "file", "offset", "length", "n_rows", "first_dt"])
        finally:
            if out is not None:
                out.close()

    rows = df.select(F.col(key).alias("code"), "dt", "unscale_pred")
    by = [files, "code", "dt"] if files else ["code", "dt"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions("code", "dt")
    ranged.mapInPandas(run, MANIFEST_SCHEMA).write.mode("overwrite").parquet(folder)
    return read_manifest(df.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path.rstrip('/')}/manifest")


def read_packed_csv(spark: SparkSession, path: str, which: Column | None = None) -> DataFrame:
    """The rows of all series, or of those whose manifest rows ``which`` picks
    (such as ``F.col("code") == "..."``): only their byte ranges are read."""
    data = f"{path.rstrip('/')}/data"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(data)
        for b in batches:
            for file, part in b.groupby("file", sort=False):
                with fs.open_input_file(f"{base}/{file}") as f:
                    for offset, length in zip(part["offset"].tolist(), part["length"].tolist()):
                        yield from _parsed(_blocks(f, offset, length))

    picked = read_manifest(spark, path)
    if which is not None:
        picked = picked.where(which)
    dealt = picked.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(run, ROWS_SCHEMA)


def _blocks(f, offset: int, length: int) -> Iterator[str]:
    """The text of a byte range, in blocks that end with a line."""
    rest, at, end = b"", offset, offset + length
    while at < end:
        block = rest + f.read_at(min(MAX_READ, end - at), at)
        at += min(MAX_READ, end - at)
        cut = len(block) if at == end else block.rfind(b"\n") + 1
        # A line break inside quotes does not end a row.
        while at < end and block[:cut].count(b'"') % 2:
            cut = block.rfind(b"\n", 0, max(cut - 1, 0)) + 1
            if not cut:
                break
        rest = block[cut:]
        if cut:
            yield block[:cut].decode()


def _parsed(blocks: Iterator[str]) -> Iterator[pd.DataFrame]:
    first = True
    for text in blocks:
        body = text[len(HEADER):] if first else text
        first = False
        rows = []
        empty_key = [line.startswith('""') and not line.startswith('"""') for line in body.split("\n")] if '""' in body else None
        for i, (code, dt, value) in enumerate(csv.reader(io.StringIO(body, newline=""))):
            code = code or ("" if empty_key and i < len(empty_key) and empty_key[i] else None)
            rows.append((code, dt or None, float(value) if value else None))
        out = pd.DataFrame(rows, columns=["code", "dt", "unscale_pred"])
        out["dt"] = pd.to_datetime(out["dt"]).dt.date
        yield out
