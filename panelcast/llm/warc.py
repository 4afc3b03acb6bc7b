"""WARC archives: an index first, then coalesced byte-range reads.

Writing. Pages become WARC/1.1 records, one gzip member each. A payload of at
least ``MIN_REVISIT`` bytes that several pages share is stored once, with the
largest page id; the others are ``revisit`` records that refer to it. Which
record refers where is decided on narrow (id, size, digest) rows with a combining
aggregate; payloads are moved once, by page id, so that no digest, however
common, gathers its payloads in one task. Each task writes a file of its own,
with a unique name, and returns the index rows: file, offset, length, URL,
digest. The index is written by Spark and alone says which files count, so a
task that is run again leaves at most a file that nothing refers to.

Reading. Any selection of index rows is dealt out by file, sorted by offset,
and neighbouring records are fetched with one read of up to ``MAX_READ``
bytes; every payload is checked against its digest.

Archives are reached through ``pyarrow.fs`` (local and HDFS, S3 and GCS
paths) and belong under the shared folder of ``spark.checkpoint.dir``.

Defined cases: null html is an empty payload; a null URL is written as an
empty one, and line breaks in URLs are percent-encoded; rows that repeat the
largest page id of a payload are all responses; null ids count as smaller than
any other; very long pages are one record each, read whole; an empty table gives
an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import materialize, scratch_path

MIN_REVISIT = 1000
#: Largest byte range of one read, and largest gap that a read may bridge.
MAX_READ = 4 << 20
MAX_GAP = 64 << 10
GZIP_LEVEL = 1
DATE = "2000-01-01T00:00:00Z"
# Fixed value: the profile name of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")


def _open_fs(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _urn(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}").urn


def _record(page_id, url: str, kind: str, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One gzip member: WARC header, HTTP header and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id, digest)}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}",
             "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to, digest)}>",
                  f"X-Refers-To-Page-Id: {refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", GZIP_LEVEL, mtime=0)


def _parse(member: bytes) -> dict:
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "record_type": kind,
            "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id"),
            "payload": payload if kind == "response" else None}


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, digest) of all pages."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"),
                        F.octet_length(body).cast("long").alias("size"), F.sha1(body).alias("digest"))


def roles(paid: DataFrame) -> DataFrame:
    """(page_id, digest, size, refers_to) of the revisits: narrow rows, one per revisit.

    The pages of a shared payload meet its one aggregate row in a join whose
    other side has unique keys, so that a very common payload can be split.
    """
    narrow = paid.where(F.col("size") >= MIN_REVISIT).select("page_id", "digest", "size")
    shared = (narrow.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and last is not null").drop("n"))
    return (narrow.join(shared, ["digest", "size"])
            .where(~F.col("page_id").eqNullSafe(F.col("last")))
            .select("page_id", "digest", "size", F.col("last").alias("refers_to")).distinct())


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all records below ``folder``; the written index of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, out, offset = None, None, 0
        try:
            for b in batches:
                rows = []
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                for page, url, payload, size, digest, ref in zip(
                        b["page_id"], b["url"], b["payload"], b["size"], b["digest"], b["refers_to"]):
                    page = None if pd.isna(page) else int(page)
                    ref = None if pd.isna(ref) else int(ref)
                    kind = "response" if ref is None else "revisit"
                    member = _record(page, url, kind, payload, size, digest, ref)
                    out.write(member)
                    rows.append((name, offset, len(member), url, digest, page, kind))
                    offset += len(member)
                index = pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
                index["page_id"] = index["page_id"].astype("Int64")
                yield index
        finally:
            if out is not None:
                out.close()

    paid = payloads(pages)
    back = materialize(roles(paid), "warc-roles")
    rows = (paid.alias("p").join(back.hint("shuffle_hash").alias("r"),
                                 F.col("p.page_id").eqNullSafe(F.col("r.page_id"))
                                 & (F.col("p.digest") == F.col("r.digest")) & (F.col("p.size") == F.col("r.size")), "left")
            .select("p.*", F.when(F.col("p.size") >= MIN_REVISIT, F.col("r.refers_to")).alias("refers_to")))
    return materialize(rows.mapInPandas(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the index rows given (any selection of them)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(folder)
        for b in batches:
            for file, part in b.groupby("file", sort=False):
                with fs.open_input_file(f"{base}/{file}") as f:
                    for start, end, spans in _ranges(list(zip(part["offset"], part["length"]))):
                        data = f.read_at(end - start, start)
                        found = pd.DataFrame([_parse(data[o - start:o - start + n]) for o, n in spans])
                        for c in ("page_id", "refers_to"):
                            found[c] = found[c].astype("Int64")
                        yield found if with_payload else found.drop(columns="payload")

    picked = (index.select("file", "offset", "length").repartition("file")
              .sortWithinPartitions("file", "offset"))
    return picked.mapInPandas(run, RECORDS if with_payload else RECORDS.removesuffix(", payload binary"))


def _ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Neighbouring (offset, length) spans, sorted, joined into ranges to read at once."""
    start, end, held = 0, 0, []
    for offset, length in spans:
        if held and (offset - end > MAX_GAP or offset + length - start > MAX_READ):
            yield start, end, held
            held = []
        if not held:
            start = offset
        held.append((offset, length))
        end = max(end, offset + length) if len(held) > 1 else offset + length
    if held:
        yield start, end, held


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back, and return what the archives say."""
    folder = scratch_path(spark, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, size) AS last FROM p),
r AS (SELECT *, size >= 1000 AND page_id <> last AS again FROM m)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM r
"""
