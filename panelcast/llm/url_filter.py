"""URL filters: rules first, then a character language-model ratio, in DataFrame functions only.

Rules (host and path prefixes, longest first) judge the URLs that they fit.
Those URLs also train two variable-order Markov models, one of accepted and
one of rejected URLs, and the other URLs are judged by the difference of
their log-likelihoods, divided by their length, against a threshold.

Models. A URL is padded with ``ORDER`` start marks and one end mark, so that
each character has a full context of ``ORDER`` characters. The distinct
windows (context and character) are counted once over all distinct URLs;
the grams of every lower order follow from that table by dropping the first
character. A gram's probability mixes its share in its context with the
probability of the next shorter context, weighted by how many characters the
context was followed by (Witten-Bell), down to a uniform distribution over the
characters seen. Contexts and gram suffixes have at most one row per
character of the alphabet, so no aggregate, window or join of the model has a
hot key; the model grows with the distinct windows and is never collected.

Scores. A window's log ratio is kept in millionths, as an integer, so that sums
do not depend on their order. Windows of all distinct URLs meet the table of
ratios by gram; those of very common grams (known from the counts, at most
``HEAVY``) meet a broadcast part, the rest is shuffled. Ratios are added up
per URL before they move.

Calibration. ``CALIBRATE`` of 16 parts of the URLs with a rule (by MD5) are kept
out of the models; the threshold, in thousandths per character, is the one
of their scores that gives the best balanced accuracy (of equal ones the one
nearest to 0, then the smaller). Without such URLs of both kinds it is 0.

Defined cases: a null URL counts as an empty one; host and path are empty
without ``://``; equal URLs are modelled and scored once, whatever their
number, and every row gets its own result; null and repeated ids are rows
like others; very long URLs are scored whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import join_counted
from panelcast.session import materialize

ORDER = 4
CALIBRATE = 4
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PLACE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PLACE, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is tried first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def distinct_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One written row per distinct URL: key, url, copies, verdict of its rule, and whether it calibrates."""
    u = (pages.select(F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"))
         .groupBy("url").agg(F.count(F.lit(1)).alias("copies")))
    digest = F.md5("url")
    return materialize(u.select(
        F.unhex(digest).alias("key"), "url", "copies",
        rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict"),
        (F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") < CALIBRATE).alias("calibrates")), "url-distinct")


def windows(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``urls`` with a row per character (and end mark): ``gram`` is its context and itself."""
    chars = F.concat(F.array_repeat(F.lit(START), order), F.filter(F.split("url", ""), lambda c: c != ""),
                     F.array(F.lit(END)))
    u = urls.withColumn("chars", chars)
    grams = F.transform(F.sequence(F.lit(1), F.size("chars") - order),
                        lambda i: F.array_join(F.slice(F.col("chars"), i, F.lit(order + 1)), ""))
    return u.withColumn("gram", F.explode(grams)).drop("chars")


def gram_counts(urls: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Written tables (gram, allow, block, n) of the grams of 1 to ``order`` + 1 characters."""
    def of(verdict: str) -> Column:
        return F.sum(F.when((F.col("verdict") == verdict) & ~F.col("calibrates"), 1).otherwise(0)).alias(verdict)

    top = windows(urls, order).groupBy("gram").agg(of("allow"), of("block"), F.count(F.lit(1)).alias("n"))
    tables = [materialize(top, f"url-grams-{order + 1}")]
    for size in range(order, 0, -1):
        shorter = tables[0].groupBy(F.substring("gram", 2, size).alias("gram")).agg(
            *[F.sum(c).alias(c) for c in ("allow", "block", "n")])
        tables.insert(0, materialize(shorter, f"url-grams-{size}"))
    return tables


def log_ratios(tables: list[DataFrame]) -> DataFrame:
    """(gram, n, ratio) of the longest grams; written. ``ratio`` is in millionths of a nat."""
    alphabet = tables[0].count()
    lower = None
    for size, grams in enumerate(tables, 1):
        context = Window.partitionBy(F.substring("gram", 1, size - 1))
        d = grams
        for c in ("allow", "block"):
            d = (d.withColumn(f"{c}_seen", F.sum(c).over(context))
                  .withColumn(f"{c}_kinds", F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(context)))
        if lower is None:
            d = d.withColumns({f"{c}_below": F.lit(1.0 / max(alphabet, 1)) for c in ("allow", "block")})
        else:
            d = d.withColumn("suffix", F.substring("gram", 2, size - 1)).join(lower, "suffix")
        d = d.select("gram", "n", *[
            F.when(F.col(f"{c}_seen") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_below"))
                   / (F.col(f"{c}_seen") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_below")).alias(f"{c}_p")
            for c in ("allow", "block")])
        lower = d.select(F.col("gram").alias("suffix"), *[F.col(f"{c}_p").alias(f"{c}_below") for c in ("allow", "block")])
    ratio = F.floor((F.log("allow_p") - F.log("block_p")) * 1e6 + 0.5)
    return materialize(d.select("gram", "n", ratio.cast("long").alias("ratio")), "url-ratios")


def scored(urls: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """``urls`` without the URL itself, with ``score`` (nats a character) and ``margin`` (thousandths); written."""
    total = ratios.agg(F.sum("n")).first()[0] or 0
    rows = windows(urls.select("key", "url"), order).select("key", "gram")
    sums = (join_counted(rows, ratios, "gram", "n", total).groupBy("key")
            .agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("size")))
    return materialize(urls.drop("url").join(sums, "key").select(
        "key", "copies", "verdict", "calibrates", (F.col("sum") / F.col("size") / 1e6).alias("score"),
        F.floor(F.col("sum") / (F.col("size") * 1000)).alias("margin")), "url-scores")


def threshold(scores: DataFrame) -> int:
    """The margin from which URLs are accepted; one row per distinct margin is looked at."""
    def number(verdict: str) -> Column:
        return F.sum(F.when(F.col("verdict") == verdict, 1).otherwise(0)).cast("decimal(18,0)").alias(verdict)

    # Margins are whole thousandths within the models' range, so their number does not grow with the URLs.
    bins = scores.where("calibrates and verdict is not null").groupBy("margin").agg(number("allow"), number("block"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("margin").rowsBetween(Window.unboundedPreceding, -1)
    below = {c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("decimal(18,0)") for c in ("allow", "block")}
    totals = {c: F.sum(c).over(every).cast("decimal(18,0)") for c in ("allow", "block")}
    both = (totals["allow"] - below["allow"]) * totals["block"] + below["block"] * totals["allow"]
    best = (bins.withColumn("gain", both).withColumn("kinds", F.least(totals["allow"], totals["block"]))
            .where("kinds > 0").orderBy(F.desc("gain"), F.abs("margin"), "margin").first())
    return best["margin"] if best else 0


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES,
           order: int = ORDER) -> DataFrame:
    """Per row: ``page_id``, host, path, rule, verdict, and the models' score."""
    urls = distinct_urls(pages, url, rules)
    scores = scored(urls, log_ratios(gram_counts(urls, order)), order)
    limit = threshold(scores)
    total = scores.agg(F.sum("copies")).first()[0] or 0
    found = scores.select("key", "copies", "score", F.when(F.col("margin") >= limit, "allow").otherwise("block").alias("other"))
    full = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), full.alias("url"), F.unhex(F.md5(full)).alias("key"))
    rows = rows.select("page_id", "key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    return join_counted(rows, found, "key", "copies", total).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", "other").alias("verdict"), "score")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judged(pages)


def oracle_sql(order: int = ORDER) -> str:
    rules = sorted(RULES, key=lambda r: -len(r.name))
    case = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'"
        for i, r in enumerate(rules)) + " END"
    rule, verdict = case.format(*[r.name for r in rules]), case.format(*[r.verdict for r in rules])
    parts = [f"""
p AS (SELECT page_id, coalesce(url, '') AS url,
             translate(regexp_extract(coalesce(url, ''), '{PLACE}', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '{PLACE}', 2) AS path FROM pages),
j AS (SELECT *, {rule} AS rule, {verdict} AS said FROM p),
u AS (SELECT DISTINCT url, said, substr(md5(url), 1, 1) IN ({", ".join(f"'{i:x}'" for i in range(CALIBRATE))}) AS cal FROM j),
x AS (SELECT url, said, cal, unnest(range(1, length(url) + 2)) AS i,
             repeat(chr(2), {order}) || url || chr(3) AS padded FROM u),
w AS (SELECT url, said, cal, substr(padded, i, {order + 1}) AS gram FROM x),
g{order + 1} AS (SELECT gram, count(*) FILTER (said = 'allow' AND NOT cal) AS allow,
                        count(*) FILTER (said = 'block' AND NOT cal) AS block FROM w GROUP BY gram)"""]
    for size in range(order, 0, -1):
        parts.append(f"g{size} AS (SELECT substr(gram, 2, {size}) AS gram, sum(allow) AS allow, sum(block) AS block "
                     f"FROM g{size + 1} GROUP BY 1)")
    for size in range(1, order + 2):
        mix = ", ".join(f"CASE WHEN sum({c}) OVER c > 0 THEN ({c} + count(*) FILTER ({c} > 0) OVER c * {c}_b) "
                        f"/ (sum({c}) OVER c + count(*) FILTER ({c} > 0) OVER c) ELSE {c}_b END AS {c}_p"
                        for c in ("allow", "block"))
        below = ("(SELECT *, 1.0::DOUBLE / (SELECT count(*) FROM g1) AS allow_b, "
                 "1.0::DOUBLE / (SELECT count(*) FROM g1) AS block_b FROM g1)" if size == 1 else
                 f"(SELECT g{size}.*, l.allow_p AS allow_b, l.block_p AS block_b FROM g{size} "
                 f"JOIN l{size - 1} l ON l.gram = substr(g{size}.gram, 2, {size - 1}))")
        parts.append(f"l{size} AS (SELECT gram, {mix} FROM {below} WINDOW c AS (PARTITION BY substr(gram, 1, {size - 1})))")
    parts.append(f"""
s AS (SELECT url, any_value(said) AS said, any_value(cal) AS cal, count(*) AS size,
             sum(CAST(floor((ln(allow_p) - ln(block_p)) * 1e6 + 0.5) AS BIGINT)) AS total
      FROM w JOIN l{order + 1} USING (gram) GROUP BY url),
m AS (SELECT url, said, cal, CAST(total AS DOUBLE) / size / 1e6 AS score,
             CAST(floor(CAST(total AS DOUBLE) / (size * 1000)) AS BIGINT) AS margin FROM s),
b AS (SELECT margin, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block
      FROM m WHERE cal AND said IS NOT NULL GROUP BY margin),
t AS (SELECT margin, sum(allow) OVER () AS a, sum(block) OVER () AS k,
             coalesce(sum(allow) OVER before, 0) AS la, coalesce(sum(block) OVER before, 0) AS lk
      FROM b WINDOW before AS (ORDER BY margin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT coalesce((SELECT margin FROM t WHERE least(a, k) > 0
                       ORDER BY (a - la) * k + lk * a DESC, abs(margin), margin LIMIT 1), 0) AS limit_)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN margin >= limit_ THEN 'allow' ELSE 'block' END) AS verdict, score
FROM (SELECT j.*, m.score, m.margin FROM j JOIN m ON j.url = m.url), h""")
    return "WITH " + ",\n".join(x.strip() for x in parts[:-1]) + ",\n" + parts[-1].strip()
