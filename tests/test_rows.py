"""Rejected lines, row accounts, ordered selection, whole-frame fill, order of appearance."""

import datetime as dt
import os
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from panelcast.operators import accounting, topk
from panelcast.operators.panel import codes_in_order
from panelcast.operators.series import forward_fill_frame
from panelcast.sources import readers, reject_ledger

LINES = """time_key,sites,node_desc,ds_load
1/2/2018,007,n1,1.5
1/3/2018,007,n1,abc
1/4/2018,7,n2,"2,5"
1/5/2018,7,n2
1/6/2018,7,n2,1,2
13/45/2018,8,n,x
,8,n,
2/3/2018,8,n,NaN
"""


@pytest.fixture()
def csv_dir(tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "w", encoding="utf-8") as f:
        f.write(LINES)
    return tmp_dir


def test_a_malformed_line_is_an_error_whichever_columns_are_read(spark, csv_dir):
    for columns in (["sites"], ["ds_load"], ["time_key", "sites", "node_desc", "ds_load"]):
        with pytest.raises(SparkRuntimeException, match="malformed line"):
            readers.read_csv(spark, f"{csv_dir}/in").select(*columns).collect()
    with pytest.raises(SparkRuntimeException, match="malformed line"):
        readers.read_csv(spark, f"{csv_dir}/in").count()


def test_ledger_and_rows_are_all_lines(spark, csv_dir):
    def load(name):
        return reject_ledger.load_csv(spark, f"{csv_dir}/in", f"{csv_dir}/ledger", name,
                                      dates={"time_key": readers.RAW_DATE_FORMAT}, ordinal=True)

    got = load("one")
    rows = got.rows.orderBy("_ord").collect()
    assert [(r.time_key, r.sites) for r in rows] == [("1/2/2018", "007"), (None, "8"), ("2/3/2018", "8")]
    assert rows[0].ds_load == 1.5 and rows[1].ds_load is None and rows[2].ds_load != rows[2].ds_load
    assert got.rows.select("sites").count() == 3  # whichever columns are read
    rejects = [(r.row, r.column, r.reason) for r in got.rejects.orderBy("row", "column").collect()]
    assert rejects == [
        (1, "ds_load", "not a double: abc"), (2, "ds_load", "not a double: 2,5"),
        (3, None, "not a line of 4 fields"), (4, None, "not a line of 4 fields"),
        (5, "ds_load", "not a double: x"), (5, "time_key", "not a date: 13/45/2018")]
    assert {r.record for r in got.rejects.collect()} >= {"1/3/2018,007,n1,abc", '1/4/2018,7,n2,"2,5"', "1/6/2018,7,n2,1,2"}
    # A load that is run again replaces its own lines; other loads stay.
    load("two")
    load("one")
    counts = {r.load: (r.n_lines, r.n_fields) for r in reject_ledger.rejected_counts(
        reject_ledger.read_ledger(spark, f"{csv_dir}/ledger")).collect()}
    assert counts == {"one": (5, 6), "two": (5, 6)}
    assert rows and counts["one"][0] + len(rows) == LINES.count("\n") - 1
    with pytest.raises(ValueError):
        load("a/b")


def test_accounts_add_up(spark):
    day = dt.date(2020, 1, 1)
    rows = [(day + dt.timedelta(i), "s", n, v) for n, size in (("a", 12), ("b", 4)) for i, v in
            ((i, -9e7 if i == 8 else float(i)) for i in range(size))]
    rows += [(None, "s", "a", 1.0), (day, None, "a", 1.0), (day, "s", "a", None), (day, "s", "a", float("nan")), (None, None, None, None)]
    raw = spark.createDataFrame(rows, "time_key date, sites string, node_desc string, ds_load double")
    account = accounting.RowAccount()
    panel = accounting.clean_measurements(raw, account).select(F.col("market").alias("code"), F.col("date").alias("dt"), F.col("value").alias("Y"))
    frame = accounting.model_frame(panel, account, tracking_days=3)
    n = len(frame.collect())
    assert account.counts() == {
        "clean": {"null_date": 2, "null_key": 1, "null_load": 2, "kept": 16},
        "series": {"short_series": 4, "kept": 12},
        "lags": {"missing_lag": 3, "sentinel": 4, "kept": 5}}
    assert n == 5 and "Y" in frame.columns
    assert {r.n_rows for r in account.table(spark).where("reason = 'kept'").collect()} == {16, 12, 5}


def test_an_account_that_does_not_agree_is_an_error(spark):
    account = accounting.RowAccount()
    first = account.observe(spark.range(10).toDF("x"), "first", {"low": F.col("x") < 3})
    account.observe(first.unionByName(first), "second", {"high": F.col("x") > 7}, follows="first").collect()
    with pytest.raises(RuntimeError):
        account.counts()


@pytest.mark.parametrize("by", [["d", "s", "i"], ["s", "d", "i"], ["t", "i"], ["d"]])
def test_top_k_by_slices(spark, by):
    rnd = random.Random(5)
    values = [None, float("nan"), float("-inf"), 1.5, 2.5, *[rnd.randint(0, 40) / 4 for _ in range(30)]]
    rows = [(rnd.choice(values), rnd.choice([None, "", "a", "b", "é"]), None if i % 50 == 0 else dt.date(2020, 1, 1) + dt.timedelta(i % 90), i)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "d double, s string, t date, i int").repartition(5)

    def place(r):
        at = dict(zip("dsti", r))
        return [(at[c] is not None, at[c] != at[c], 0 if at[c] is None or at[c] != at[c] else at[c]) for c in by]

    want = sorted(map(place, rows))
    for k in (1, 7, 200, 2999, 3000, 4000):
        got = [place(tuple(r)) for r in topk.top_k_rows(df, k, by).collect()]
        assert got == want[:k]
    assert topk.top_k_rows(df, 0, by).collect() == [] and topk.top_k_rows(df.limit(0), 5, by).collect() == []


def test_top_k_moves_only_the_answer(spark, tmp_dir):
    spark.range(100_000).select(F.col("id").alias("x"), F.xxhash64("id").alias("y")).write.parquet(f"{tmp_dir}/t")
    got = topk.top_k_rows(spark.read.parquet(f"{tmp_dir}/t"), 5000, ["x"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(x,4999)" in plan and "Window" not in plan
    assert got.agg(F.max("x"), F.count("x")).first() == (4999, 5000)


def test_fill_crosses_series_and_slices(spark):
    rnd = random.Random(3)
    rows = [(f"c{i // 9:03d}", i % 9, None if i % 9 < 2 or rnd.random() < 0.6 else float(i)) for i in range(180)]
    want, last = [], None
    for code, d, y in rows:
        last = y if y is not None else last
        want.append((code, d, y, last))
    df = spark.createDataFrame(rows, "code string, dt int, Y double").repartition(4)
    for p in (1, 7, 50):
        got = forward_fill_frame(df, "Y", out="Z", partitions=p).orderBy("code", "dt").collect()
        assert [tuple(r) for r in got] == want
    assert forward_fill_frame(df.limit(0)).collect() == []


def test_codes_by_appearance_over_files_of_unequal_size(spark, tmp_dir):
    rnd = random.Random(9)
    rows, at = [(f"code{rnd.randint(0, 300)}", i) for i in range(5000)], 0
    for part, size in enumerate((3000, 1, 1500, 20, 479)):  # large files come first, middle and last
        spark.createDataFrame(rows[at:at + size], "code string, i int").coalesce(1).write.parquet(f"{tmp_dir}/f{part}")
        at += size
    files = readers.read_parquet(spark, f"{tmp_dir}/f*", ordinal=True)
    got = {r.code: r.place for r in codes_in_order(files).collect()}
    assert got == {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in rows))}
    assert codes_in_order(files.limit(0)).collect() == []
