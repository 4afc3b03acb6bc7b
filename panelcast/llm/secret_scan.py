"""Secret scans over an incremental blob ledger.

Every historical version of a text is addressed by its content (SHA-256).
The ledger holds, per (blob, rule version), the spans that were found. A scan
takes only the blobs that the ledger does not have for the current rules,
once each however many paths share them, appends their findings, and joins
the ledger back to all paths.

Plan: one pass hashes the texts and writes the narrow (key, blob) table; one
representative row per unseen blob is chosen by a combining aggregate, so a
blob that holds a third of all rows stays one row; only the representatives'
texts meet the Python scanner, dealt out by their own keys. A later run over
mostly known versions moves only the new texts.

Spans are code point offsets, end exclusive. The base kinds are ``assign``,
``access`` and ``hex``; the rules here add well-known token formats. A private
key's span runs from its BEGIN line through the key to the END line of the same
label; where another BEGIN or END or the text's end comes first, it ends with
the last line of the key (base64 and the headers before it).

Defined cases: null texts are read as empty (no findings, one shared blob);
null and repeated keys are kept, each row gets the findings of its own text;
very long texts are scanned whole; spans that start together are ordered by kind;
an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, text_of
from panelcast.session import materialize, scratch_path

RULES_VERSION = "r2"
#: Session setting that names a folder for a ledger that later runs go on with.
LEDGER_CONF = "spark.panelcast.secretLedger"
BASE_KINDS = ("assign", "access", "hex")

# The base patterns (shorter matches are dropped after matching).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ASSIGN_MIN = 12
# A maximal run that is long enough is the same as a match with that minimum.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# What follows the BEGIN line of a key without its END: headers, then pieces of
# 16 letters or more in any layout (quoted, escaped, on one line), or whole lines next to them.
_GAP = r"""(?:[\s"'`,;>#|*+]|\\[nrt])*+"""
_KEY_LINES = (rf"""(?:{_GAP}[A-Z][A-Za-z0-9]*-[A-Za-z0-9-]+:[^\n\\]*+)*+"""
              rf"""(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+"""
              r"""|[ \t"']*+(?:\r?\n|\\r\\n|\\n)[ \t>#"']*+[A-Za-z0-9+/=]++(?=[ \t\r"',;]*(?:\n|\\|\Z)))*+""")
# Public token formats that the ledger's rules add.
ADDED = {
    "private_key": re.compile(
        r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----"
        rf"(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END \1-----|{_KEY_LINES})"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
KINDS = (*BASE_KINDS, *ADDED)
SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start and then by kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= ASSIGN_MIN]
    patterns = (ACCESS, HEX, *ADDED.values())
    for k, p in enumerate(patterns, start=1):
        found += [(m.start(), k, m.end()) for m in p.finditer(text)]
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done: set[bytes] = set()  # rows that repeat a key and its text meet in one task
    for b in batches:
        new = [x not in done and not done.add(x) for x in map(bytes, b["blob"])]
        b = b[np.array(new, bool)]
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in b["text"]]
        yield pd.DataFrame({"blob": b["blob"], "spans": spans})


def address(versions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The (key, blob) table of all versions, written once."""
    return materialize(versions.select(
        F.col(f"`{key}`").alias("key"), _blob(text).alias("blob")), "blob-address")


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def unseen(addressed: DataFrame, ledger: DataFrame | None, version: str = RULES_VERSION) -> DataFrame:
    """One (key, blob) row per blob that the ledger lacks for these rules."""
    reps = addressed.groupBy("blob").agg(F.min(F.struct("key")).alias("rep"))
    if ledger is not None:
        known = ledger.where(F.col("version") == version).select("blob")
        reps = reps.join(known, "blob", "left_anti")
    return reps.select("blob", F.col("rep.key").alias("key"))


def scan(versions: DataFrame, ledger_path: str, key: str = "doc_id", text: str = "text",
         version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger at ``ledger_path`` up to date.

    Returns the (key, blob) table of all versions and the ledger.
    """
    spark = versions.sparkSession
    addressed = address(versions, key, text)
    ledger = read_ledger(spark, ledger_path)
    todo = materialize(unseen(addressed, ledger, version), "blob-todo")
    # A first scan takes nearly all texts: hash tables of the narrow list, texts unsorted. Later
    # lists are as small as what is new, and Spark may broadcast them by their written size.
    listed = todo.hint("shuffle_hash") if ledger is None else todo
    texts = versions.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"),
                            _blob(text).alias("blob"))
    picked = texts.alias("t").join(
        listed.alias("r"),
        (F.col("t.blob") == F.col("r.blob")) & F.col("t.key").eqNullSafe(F.col("r.key")), "left_semi")
    found = picked.select("t.blob", "t.text").mapInPandas(_scan, f"blob binary, spans {SPANS}")
    # Rows that repeat a key and its text were both picked; one entry per blob is written.
    entries = found.groupBy("blob").agg(F.first("spans").alias("spans"))
    entries.withColumn("version", F.lit(version)).write.mode("append").parquet(ledger_path)
    return addressed, read_ledger(spark, ledger_path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, one entry per blob and rule version, or None where there is none yet.

    Two scans that ran at the same time may both have entered a blob.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    entries = spark.read.schema(f"blob binary, spans {SPANS}, version string").parquet(path)
    return entries.groupBy("blob", "version").agg(F.first("spans").alias("spans")).select("blob", "spans", "version")


def session_ledger(spark: SparkSession, version: str = RULES_VERSION) -> str:
    """The ledger of this session's scans: the folder that ``spark.panelcast.secretLedger``
    names (kept between runs, one below it per rule version), else a fresh one."""
    kept = spark.conf.get(LEDGER_CONF, None)
    return f"{kept.rstrip('/')}/{version}" if kept else scratch_path(spark, "secret-ledger")


def findings(addressed: DataFrame, ledger: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """(key, spans) of every path. Only blobs with findings take part in the join."""
    hits = ledger.where((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    return addressed.join(hits, "blob", "left").select(
        "key", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    addressed, ledger = scan(docs, session_ledger(spark))
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return findings(addressed, ledger).select(
        F.col("key").alias("doc_id"), *[count(k) for k in BASE_KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame, text: str = "text", mark: str = "[SECRET]",
           version: str = RULES_VERSION) -> DataFrame:
    """``docs`` with every found span replaced; texts without findings are unchanged."""
    blob, spans = fresh(docs, "blob", "spans")
    hits = (ledger.where((F.col("version") == version) & (F.size("spans") > 0))
            .select(F.col("blob").alias(blob), F.col("spans").alias(spans)))
    d = docs.withColumn(blob, _blob(text)).join(hits, blob, "left")
    # Runs of text before each span that is not inside an earlier one, then the rest.
    init = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    body = F.col(f"`{text}`")
    cut = F.aggregate(
        F.col(f"`{spans}`"), init,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["done"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("done"),
            s["end"].alias("at"))).otherwise(F.struct(
                acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["done"], F.substring(body, acc["at"] + 1, F.length(body))))
    clean = F.when(F.col(f"`{spans}`").isNotNull(), cut).otherwise(body)
    d = d.withColumn(text, clean)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(f"`{spans}`").isNotNull(), F.length(text).cast("long"))
                         .otherwise(F.col("n_chars")))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])
