"""Packed sink, merged moments, incremental lag frames: equal to the plain way."""

import datetime as dt
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from panelcast.operators import lag_state, lags, moments, scale
from panelcast.sources import packed

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_packed_files_are_bounded_and_read_by_range(spark, tmp_dir):
    df = spark.range(200_000).select(F.format_string("s%06d", F.expr("id div 2")).alias("code"),
                                     F.expr("date_add(date'2020-01-01', cast(id % 2 as int))").alias("dt"),
                                     (F.col("id") / 7).alias("unscale_pred"))
    manifest = packed.write_packed_csv(df, f"{tmp_dir}/p", files=6)
    assert manifest.select("code").distinct().count() == 100_000
    assert manifest.select("file").distinct().count() <= 6
    one = manifest.where("code = 's012345'").collect()
    assert sum(r.n_rows for r in one) == 2
    path = f"{tmp_dir}/p/data/{one[0].file}"
    with open(path, "rb") as f:
        f.seek(one[0].offset)
        text = f.read(one[0].length).decode()
    assert text.startswith(packed.HEADER) and text.count("\n") == 1 + one[0].n_rows
    got = packed.read_packed_csv(spark, f"{tmp_dir}/p", F.col("code") == "s012345").collect()
    assert sorted((r.code, r.dt, r.unscale_pred) for r in got) == [("s012345", day(0), 24690 / 7), ("s012345", day(1), 24691 / 7)]
    assert packed.read_packed_csv(spark, f"{tmp_dir}/p").exceptAll(df).count() == 0


def test_packed_odd_keys_and_a_long_series(spark, tmp_dir, monkeypatch):
    codes = [None, "", 'quo"te', '"', '""', "comma,key", "line\nbreak", "é ü", " x ", "null"]
    rows = [(c, day(i), None if i == 3 else i / 3) for c in codes for i in range(5)] + [("long", day(i), float(i)) for i in range(2000)]
    rows += [("a", None, 1.0), ("a", None, None)]
    df = spark.createDataFrame(rows, "code string, dt date, unscale_pred double").repartition(3)
    monkeypatch.setattr(packed, "MAX_READ", 97)
    monkeypatch.setattr(packed, "HELD_ROWS", 10)
    manifest = packed.write_packed_csv(df, f"{tmp_dir}/p", files=5)
    assert manifest.where("code = 'long'").count() > 1  # one series over several files
    back = packed.read_packed_csv(spark, f"{tmp_dir}/p")
    assert back.exceptAll(df).collect() == [] and df.exceptAll(back).collect() == []
    assert packed.read_packed_csv(spark, f"{tmp_dir}/p", F.col("code").isNull()).count() == 5
    packed.write_packed_csv(df.limit(0), f"{tmp_dir}/none")
    assert packed.read_packed_csv(spark, f"{tmp_dir}/none").collect() == []


def test_merged_moments_are_those_of_the_full_pass(spark, tmp_dir):
    rnd = random.Random(2)
    rows = [(day(rnd.randint(0, 40)), 1e6 + rnd.gauss(0, 1), None if i % 3 else float(i), 5.0, None) for i in range(900)]
    df = spark.createDataFrame(rows, "dt date, a double, b double, c double, d double")
    cols, path = ["a", "b", "c", "d"], f"{tmp_dir}/m"
    old, new = df.where(F.col("dt") < day(30)), df.where(F.col("dt") >= day(30))
    moments.append_moments(old, cols, path, "one")
    moments.append_moments(new.limit(5), cols, path, "two")
    table = moments.append_moments(new, cols, path, "two")  # a load that is run again replaces its rows
    got = {k: v.first() for k, v in moments.merged(table, cols).items()}
    for c in cols:
        want = df.agg(F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).first()
        assert [got[k][c] for k in ("n", "mean", "std", "min", "max")] == [
            x if x is None or isinstance(x, int) else pytest.approx(x, rel=1e-9, abs=1e-9) for x in want]
    a = scale.zscore(df, ["a"], *moments.zscore_statistics(table, ["a"]))[0].agg(F.stddev_samp("a"), F.avg("a")).first()
    assert a[0] == pytest.approx(1) and a[1] == pytest.approx(0, abs=1e-6)
    lo, hi = moments.minmax_statistics(table, ["b"])
    assert scale.minmax_shifted(df, ["b"], lo, hi)[0].agg(F.max("b")).first()[0] == pytest.approx(1)
    one = moments.merged(moments.append_moments(df.where("b = 0"), ["b"], f"{tmp_dir}/n", "x"), ["b"])
    assert (one["n"].first().b, one["mean"].first().b, one["std"].first().b) == (1, 0.0, None)
    with pytest.raises(ValueError):
        moments.append_moments(df, cols, path, "a/b")


@pytest.mark.parametrize("strategy", ["window", "balanced"])
def test_appends_give_the_frame_of_all_rows(spark, strategy):
    rnd = random.Random(6)
    rows = [(code, day(i), i % 4, rnd.gauss(0, 1), None if rnd.random() < 0.1 else float(i))
            for code, size in ((None, 20), ("a", 30), ("b", 4), ("c", 5), ("d", 1), ("e", 3)) for i in range(size)]
    df = spark.createDataFrame(rows, "code string, dt date, tie int, Y double, Z double")
    kw = {"tracking_days": 3, "columns": ["Y", "Z"], "order": ("dt", "tie")}
    want = lags.lag_frame(df, **kw)
    state, parts = None, []
    # The cuts leave series below, at and above the N + 2 rows from which they count.
    for lo, hi in ((0, 4), (4, 5), (5, 40)):
        new = df.where((F.col("dt") >= day(lo)) & (F.col("dt") < day(hi)))
        added, state = lag_state.append(state, new, strategy=strategy, **kw)
        parts.append(added)
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    assert want.count() > 20 and got.columns == want.columns
    assert got.exceptAll(want).collect() == [] and want.exceptAll(got).collect() == []
    held = {r.code: (r.n, r.seen) for r in state.rows.groupBy("code").agg(F.count("dt").alias("n"), F.max("_seen").alias("seen")).collect()}
    assert held == {None: (4, 20), "a": (4, 30), "b": (4, 4), "c": (4, 5), "d": (1, 1), "e": (3, 3)}
    with pytest.raises(SparkRuntimeException, match="do not come after"):
        lag_state.append(state, df.where("code = 'e'"), strategy=strategy)
