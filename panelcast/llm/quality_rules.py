"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the raw
measurements and one integer whose bits say which rules failed. Policies are
versioned bit masks over that integer, so trying another policy, or asking
what one rule alone removes, reads the ledger and never the texts again.

The ledger is a narrow, row-wise plan (no shuffle): words, lines and 3-word
windows are arrays of their own row. Windows are compared by a 64-bit hash
within one text.

Defined cases: a null or empty text has no words and no lines (all counts 0,
so it fails ``few_words``); a text of fewer than three words has no window;
repeated rows give repeated ledger rows; very long texts are measured whole; a
measure that equals its limit passes; an empty table gives an empty
ledger; null ids are carried along; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import fresh, pinned, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_UPPER_PERCENT = 50
MAX_MEAN_WORD = 25
MAX_DUP_LINE_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper")


def _rules(m: dict[str, Column]) -> dict[str, Column]:
    """Rule name -> condition under which it fails; the order fixes the bits."""
    return {
        "few_words": m["n_words"] < MIN_WORDS,
        "repeated_windows": 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"],
        "symbols": 100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * m["word_chars"],
        "upper_case": 100 * m["n_upper"] > MAX_UPPER_PERCENT * m["word_chars"],
        "long_words": m["word_chars"] > MAX_MEAN_WORD * m["n_words"],
        "dup_lines": 100 * m["n_dup_lines"] > MAX_DUP_LINE_PERCENT * m["n_lines"],
    }


RULES = ("few_words", "repeated_windows", "symbols", "upper_case", "long_words", "dup_lines")
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
#: In production; repeated lines alone do not remove a document.
V1 = Policy("v1", ("few_words", "repeated_windows", "symbols", "upper_case", "long_words"))
STRICT = Policy("strict", RULES)


def failed(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask)) != 0


def evaluate(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` with a struct column ``out``: all measurements and ``bits``."""
    w, lines, windows, at = fresh(docs, "words", "lines", "windows", "at")
    body = text_of(text)
    d = (docs.withColumn(w, pinned(words_of(body)))
         .withColumn(lines, pinned(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))))
    arr = F.col(w)
    d = d.withColumn(windows, pinned(F.when(F.size(arr) >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(arr) - 3),
        lambda i: F.struct(F.xxhash64(F.get(arr, i), F.get(arr, i + 1), F.get(arr, i + 2)).alias("h"),
                           i.alias("i")))))))
    seen = F.col(windows)
    # Equal windows are neighbours in the sorted array; keep the places of those with a twin.
    twins = F.filter(seen, lambda x, j: (F.get(seen, j - 1)["h"] == x["h"])
                     | (F.get(seen, j + 1)["h"] == x["h"]))
    d = d.withColumn(at, pinned(F.sort_array(F.transform(twins, lambda x: x["i"]))))
    pos = F.col(at)
    covered = F.aggregate(
        F.transform(pos, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(pos, j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    m = {
        "n_words": F.size(arr).cast("long"),
        "word_chars": F.length(F.array_join(arr, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(F.col(lines)) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_lines": F.size(F.col(lines)).cast("long"),
        "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
    }
    (raw,) = fresh(d, "measures")
    d = d.withColumn(raw, pinned(F.struct(*[m[k].alias(k) for k in MEASURES])))
    got = {k: F.col(raw)[k] for k in MEASURES}
    bits = sum((F.when(bad, F.lit(BIT[name])).otherwise(F.lit(0))
                for name, bad in _rules(got).items()), F.lit(0))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns],
                    F.struct(*[got[k].alias(k) for k in MEASURES], bits.alias("bits")).alias(out))


def ablations(ledger: DataFrame, policy: Policy = V1, bits: str = "ledger.bits") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and
    that the policy would keep without it.

    The ledger is first counted per bit pattern (at most ``2 ** len(RULES)``
    groups, combined before the shuffle); the rest is bit arithmetic.
    """
    patterns = ledger.groupBy(F.col(bits).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    per_rule = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules]))
    active = F.col("b").bitwiseAND(F.lit(policy.mask))

    def docs_where(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return (patterns.select("b", "n", per_rule.alias("r"))
            .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
            .agg(docs_where(F.col("b").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
                 docs_where(active == F.col("r.bit")).alias("n_failed_alone"),
                 docs_where((active == 0) | (active == F.col("r.bit"))).alias("n_kept_without")))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: measurements, failure bits and the production verdict."""
    led = evaluate(docs.select("doc_id", "text"))
    bits = F.col("ledger.bits")
    return led.select("doc_id", *[F.col(f"ledger.{k}").alias(k) for k in MEASURES],
                      bits.alias("failure_bits"),
                      failed(bits, BASE).alias("base_failed"),
                      (~failed(bits, V1)).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that the production policy keeps, columns unchanged."""
    (out,) = fresh(docs, "ledger")
    return evaluate(docs, out=out).where(~failed(F.col(f"`{out}`.bits"), V1)).drop(out)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c
      FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n
            FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper
  FROM t LEFT JOIN covered ON t.doc_id = covered.doc_id),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
         + 4 * (100 * n_symbols > 10 * word_chars)::INT + 8 * (100 * n_upper > 50 * word_chars)::INT
         + 16 * (word_chars > 25 * n_words)::INT
         + 32 * (100 * n_dup_lines > 30 * n_lines)::INT AS INTEGER) AS failure_bits
  FROM m)
SELECT *, (failure_bits & 3) <> 0 AS base_failed, (failure_bits & 31) = 0 AS kept FROM b
"""
