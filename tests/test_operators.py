"""Operator unit tests on small literal frames (edge cases of the semantics)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelcast.functions.calendar_features import add_calendar_features
from panelcast.functions.labels import label_expr, label_rows
from panelcast.operators import extrapolate as X
from panelcast.operators import lags, metrics, scale, series
from panelcast.operators.panel import build_panel

D0 = dt.date(2020, 1, 1)


def _series(spark, values, code="A", start=D0, step=1):
    rows = [(code, start + dt.timedelta(days=i * step), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "code string, dt date, Y double")


def test_label_days(spark):
    ds = [-32, -31, -1, 0, 1, 2, 29, 30, 31]
    df = spark.createDataFrame([(d,) for d in ds], "d int")
    got = df.select("d", label_expr(F.col("d"), "intent").alias("i"),
                    label_expr(F.col("d"), "literal").alias("l")).orderBy("d").collect()
    assert [r["i"] for r in got] == [0, 0, 0, 0, 1, 1, 1, 1, 0]
    assert [r["l"] for r in got] == [0, 0, 1, 0, 0, 1, 0, 1, 0]
    with pytest.raises(ValueError):
        label_expr(F.col("d"), "other")


def test_label_rows_absent_fault_is_zero(spark):
    rows = spark.createDataFrame([("A", "20200101"), ("B", "20200101")], "code string, k string")
    faults = spark.createDataFrame([("A", "2020-01-11")], "code string, fault_date string")
    out = label_rows(rows, faults, dt="k", dt_format="yyyyMMdd", fault_format="yyyy-MM-dd")
    assert {r["code"]: r["label"] for r in out.collect()} == {"A": 1, "B": 0}


def test_week_edges(spark):
    df = spark.createDataFrame([(dt.date(2018, 1, 7),), (dt.date(2018, 1, 1),),
                                (dt.date(2017, 1, 1),)], "dt date")
    got = {r["dt"]: r for r in add_calendar_features(df).collect()}
    sun = got[dt.date(2018, 1, 7)]
    assert (sun["week"], sun["weekofyear"], sun["isoweekday"], sun["weekday"]) == (1, 1, 7, 7)
    assert got[dt.date(2018, 1, 1)]["weekofyear"] == 1      # a Monday
    assert got[dt.date(2017, 1, 1)]["weekofyear"] == 0      # Sunday before the first Monday
    assert got[dt.date(2018, 1, 7)]["days2"] == 0 + 0 + 7


def test_week_of_year_matches_strftime_over_years(spark):
    days = [dt.date(1999, 1, 1) + dt.timedelta(days=i) for i in range(0, 365 * 12, 3)]
    df = add_calendar_features(spark.createDataFrame([(d,) for d in days], "dt date"))
    for r in df.collect():
        assert r["weekofyear"] == int(r["dt"].strftime("%W"))
        assert r["week"] == r["dt"].isocalendar()[1]
        assert r["isoweekday"] == r["dt"].isoweekday()
        assert r["dayofyear"] == int(r["dt"].strftime("%j"))


def _brute_literal(values, horizon=X.HORIZON_DAYS):
    lo, hi = min(values), max(values)
    s = [(3000 - 70) * (v - lo) / (hi - lo) + 70 for v in values]
    r = [float("nan")] + [s[i] / s[i - 1] for i in range(1, len(s))]
    r = [1.0 if (x < 0.5 or x > 5) else x for x in r]
    out, v = [], s[-1]
    for k in range(1, horizon + 1):
        v = v * r[k % len(r)]
        out.append(v)
    return [x for x in out if not math.isnan(x)], r


def _brute_cyclic(values, horizon):
    lo, hi = min(values), max(values)
    s = [(3000 - 70) * (v - lo) / (hi - lo) + 70 for v in values]
    r = [1.0] + [s[i] / s[i - 1] for i in range(1, len(s))]
    r = [1.0 if (x < 0.5 or x > 5) else x for x in r]
    out, v = [], s[-1]
    for k in range(1, horizon + 1):
        v = v * r[k % len(r)]
        out.append(v)
    return out


def test_ratio_6(spark):
    vals = [100, 110, 90, 300, 20, 25]
    state = X.scaled_series(_series(spark, vals)).orderBy("dt").collect()
    ratios = [r["ratio"] for r in state]
    assert ratios[0] is None
    assert [round(x, 5) for x in ratios[1:]] == [1.11535, 0.79315, 3.73832, 1.0, 1.74745]
    fc = X.ratio_forecast(_series(spark, vals)).orderBy("k").collect()
    assert [round(r["Y"], 5) for r in fc] == [136.43174, 108.21112, 404.52756, 404.52756, 706.89127]
    assert [r["dt"] for r in fc] == [D0 + dt.timedelta(days=5 + k) for k in range(1, 6)]
    brute, _ = _brute_literal(vals)
    assert len(brute) == 5 and all(math.isclose(a["Y"], b, rel_tol=1e-12) for a, b in zip(fc, brute))


@pytest.mark.parametrize("vals,horizon", [
    ([100, 110, 90, 300, 20, 25], 40),
    ([5, 7, 3, 9, 9, 1, 4], 23),
    ([1, 2], 9),
    ([3, 1, 2], 3651),
])
def test_ratio_cyclic_matches_brute_force(spark, vals, horizon):
    got = X.ratio_forecast_cyclic(_series(spark, vals), horizon).orderBy("k").collect()
    want = _brute_cyclic(vals, horizon)
    assert [r["k"] for r in got] == list(range(1, horizon + 1))
    for r, w in zip(got, want):
        assert math.isclose(r["Y"], w, rel_tol=1e-9)


def test_literal_forecast_many_series_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    data = {f"c{i}": [rnd.uniform(1, 1000) for _ in range(rnd.randint(2, 30))] for i in range(12)}
    rows = [(c, D0 + dt.timedelta(days=7 * j), v) for c, vs in data.items() for j, v in enumerate(vs)]
    panel = spark.createDataFrame(rows, "code string, dt date, Y double")
    got = {}
    for r in X.ratio_forecast(panel).collect():
        got.setdefault(r["code"], {})[r["k"]] = r["Y"]
    for c, vs in data.items():
        want, _ = _brute_literal(vs)
        assert len(got.get(c, {})) == len(want) == len(vs) - 1
        for k, w in enumerate(want, start=1):
            assert math.isclose(got[c][k], w, rel_tol=1e-9)


def test_constant_series(spark):
    panel = _series(spark, [5, 5, 5, 5])
    s = scale.range_scale_by_code(panel).collect()
    assert all(r["Y_scaled"] is None for r in s)
    assert X.ratio_forecast(panel).count() == 0
    assert X.ratio_forecast_cyclic(panel, 30).count() == 0


@pytest.mark.parametrize("n,expected", [(6, 0), (7, 2)])
def test_short_series(spark, n, expected):
    panel = add_calendar_features(_series(spark, list(range(1, n + 1))))
    assert lags.lag_frame(panel, 5).count() == expected


def test_lag_frame_modes(spark):
    panel = _series(spark, [1, 2, 3, 4, 5, 6, 7, 8])
    back = lags.lag_frame(panel, 2).orderBy("dt").collect()
    assert [(r["Y_000_day_before"], r["Y_001_day_before"], r["Y_002_day_before"]) for r in back] == \
        [(3.0, 2.0, 1.0), (4.0, 3.0, 2.0), (5.0, 4.0, 3.0), (6.0, 5.0, 4.0), (7.0, 6.0, 5.0),
         (8.0, 7.0, 6.0)]
    fwd = lags.lag_frame(panel, 2, mode="forward").orderBy("dt").collect()
    assert (fwd[0]["Y_000_day_before"], fwd[0]["Y_002_day_before"]) == (1.0, 3.0)
    keep = lags.lag_frame(panel, 2, drop_null=False)
    assert keep.count() == 8
    with pytest.raises(ValueError):
        lags.lag_frame(panel, 2, mode="sideways")


def test_minmax_shifted(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    out, lo, hi = scale.minmax_shifted(df, ["x"])
    got = sorted(r["x"] for r in out.collect())
    assert math.isclose(got[0], (0 - 0.001) / 0.999) and got[1] == 1.0
    const, _, _ = scale.minmax_shifted(spark.createDataFrame([(4.0,), (4.0,)], "x double"), ["x"])
    assert [r["x"] for r in const.collect()] == [1.0, 1.0]
    # Fitted statistics can be reused on another frame.
    other, _, _ = scale.minmax_shifted(spark.createDataFrame([(0.5,)], "x double"), ["x"], lo, hi)
    assert math.isclose(other.collect()[0]["x"], (0.5 - 0.001) / 0.999)


def test_zscore(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    out, mean, std = scale.zscore(df, ["x"])
    assert sorted(round(r["x"], 9) for r in out.collect()) == [-1.0, 0.0, 1.0]
    assert mean.collect()[0]["x"] == 2.0 and std.collect()[0]["x"] == 1.0


def test_unscale_inverts_scale(spark):
    panel = _series(spark, [3.5, 10.0, 7.25, 99.0])
    s = scale.range_scale_by_code(panel)
    back = s.select("Y", scale.range_unscale(F.col("Y_scaled"), F.col("xmin"), F.col("xmax"))
                    .alias("u")).collect()
    assert all(math.isclose(r["Y"], r["u"], rel_tol=1e-12) for r in back)


def test_zero_truth_excluded(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0), (4.0, 4.0)], "Y double, prediction double")
    r = metrics.mape(df).collect()[0]
    assert r["n_scored"] == 2 and r["n_zero_truth"] == 1
    assert math.isclose(r["mape"], 0.25)
    exact = spark.createDataFrame([(2.0, 2.0), (5.0, 5.0)], "Y double, prediction double")
    assert metrics.mape(exact).collect()[0]["mape"] == 0.0
    assert metrics.rmse(exact).collect()[0]["rmse"] == 0.0


def test_nulls_dropped(spark):
    raw = spark.createDataFrame([
        ("1/1/2020", "1", "A", 1.0), ("1/2/2020", "1", None, 2.0),
        ("1/3/2020", "1", "A", float("nan")), ("1/4/2020", "1", "A", 4.0)],
        "time_key string, sites string, node_desc string, ds_load double")
    panel = build_panel(raw, date_format="M/d/yyyy")
    assert sorted(r["dt"] for r in panel.collect()) == [dt.date(2020, 1, 1), dt.date(2020, 1, 4)]


def test_outlier(spark):
    df = spark.createDataFrame([(1, -1e7), (2, -1e7 - 1), (3, 5.0)], "id int, v double")
    kept = sorted(r["id"] for r in lags.drop_sentinels(df, ["v"]).collect())
    assert kept == [1, 3]


def test_daily_spine_and_ffill(spark):
    panel = spark.createDataFrame([("A", D0, 1.0), ("A", D0 + dt.timedelta(days=3), 4.0),
                                   ("B", D0, 9.0)], "code string, dt date, Y double")
    dense = series.forward_fill(series.daily_spine(panel), "Y", out="F")
    got = sorted((r["code"], r["dt"], r["Y"], r["F"]) for r in dense.collect())
    assert got == [("A", D0, 1.0, 1.0), ("A", D0 + dt.timedelta(days=1), None, 1.0),
                   ("A", D0 + dt.timedelta(days=2), None, 1.0),
                   ("A", D0 + dt.timedelta(days=3), 4.0, 4.0), ("B", D0, 9.0, 9.0)]


@pytest.mark.parametrize("k,buckets", [(300, 64), (300, 3), (1500, 5)])
def test_top_k_is_exact(spark, k, buckets):
    import random
    from panelcast.operators.panel import top_k_rows
    rnd = random.Random(11)
    rows = [(rnd.choice("abc"), None if i % 997 == 0 else rnd.randint(0, 500) / 10.0, i)
            for i in range(20000)]
    df = spark.createDataFrame(rows, "m string, value double, i int").repartition(16)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0], r[2]))[:k]
    assert [tuple(r) for r in top_k_rows(df, k, ["value", "m", "i"], buckets).collect()] == want


def test_key_market_and_table_source(spark):
    from panelcast.operators.panel import key_market
    from panelcast.sources.readers import read_table, register_view
    raw = spark.createDataFrame([(131, "JC05", 1.0), (7, None, 2.0)],
                                "sites int, node_desc string, v double")
    keyed = key_market(raw).collect()
    assert [r["market"] for r in keyed] == ["131JC05", None]
    assert keyed[0].asDict().keys() == {"v", "market"}

    hist = _series(spark, [1, 2])
    name = register_view(hist, "hist_view_test")
    assert read_table(spark, name).count() == 2


def _frame_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("mode,drop_null", [("backward", True), ("forward", True),
                                            ("backward", False)])
def test_balanced_lag_frame_matches_window(spark, mode, drop_null):
    import random
    rnd = random.Random(5)
    rows = []
    # One hot series with a third of the rows, many short ones, repeated dates.
    for i in range(600):
        rows.append(("hot", D0 + dt.timedelta(days=i // 3), float(rnd.randint(1, 99)), i))
    for c in range(40):
        for j in range(rnd.randint(1, 30)):
            rows.append((f"s{c}", D0 + dt.timedelta(days=j), float(rnd.randint(1, 99)), 1000 + c * 100 + j))
    df = spark.createDataFrame(rows, "code string, dt date, Y double, o int")
    kw = dict(mode=mode, drop_null=drop_null, columns=["Y"], order=("dt", "o"))
    window = lags.lag_frame(df, 3, **kw)
    balanced = lags.lag_frame(df, 3, strategy="balanced", **kw)
    assert _frame_rows(window) == _frame_rows(balanced)
    assert window.columns == balanced.columns


def test_strategies_keep_null_keys(spark):
    rows = [(None if i % 2 else "a", i // 2, float(i)) for i in range(18)]
    df = spark.createDataFrame(rows, "code string, dt int, Y double")
    for fn in (lambda st: lags.lag_frame(df, 2, strategy=st),
               lambda st: series.forward_fill(df, "Y", out="F", strategy=st),
               lambda st: lags.short_series_filter(df, 2, strategy=st),
               lambda st: scale.range_scale_by_code(df, strategy=st).select("code", "dt", "Y", "Y_scaled")):
        got = [sorted(map(str, map(tuple, fn(st).collect()))) for st in ("window", "balanced")]
        assert got[0] == got[1] and any("None" in r for r in got[0])
    for fn in (lambda: lags.lag_frame(df, 2, strategy="auto"), lambda: X.scaled_series(df, strategy="auto"),
               lambda: series.forward_fill(df, strategy="blocks"),
               lambda: scale.range_scale_by_code(df, strategy="x"), lambda: lags.short_series_filter(df, strategy="")):
        with pytest.raises(ValueError):
            fn()


@pytest.mark.parametrize("partitions", [1, 6, 40])
@pytest.mark.parametrize("mode", ["backward", "forward"])
def test_halo_crosses_pieces_shorter_than_it(spark, partitions, mode):
    from panelcast.operators.slices import range_slices, series_positions, with_halo
    rows = [("a", i) for i in range(50)] + [("b", i) for i in range(7)] + [(None, i) for i in range(9)]
    df = spark.createDataFrame(rows, "code string, dt int")
    got = series_positions(df, partitions=partitions, size="_rows").collect()
    assert all(r["_pos"] == r["dt"] + 1 for r in got) and len(got) == len(rows)
    assert {(r["code"], r["_rows"]) for r in got} == {("a", 50), ("b", 7), (None, 9)}
    s = range_slices(df, partitions=partitions)
    shift = F.lag if mode == "backward" else F.lead
    step = 1 if mode == "backward" else -1
    back = [shift("dt", i).over(s.window()).alias(f"l{i}") for i in range(1, 6)]
    out = with_halo(s, 5, mode).select("code", "dt", "_halo", *back).where("not _halo").collect()
    assert len(out) == len(rows)
    size = {"a": 50, "b": 7, None: 9}
    for r in out:
        for i in range(1, 6):
            want = r["dt"] - step * i
            assert r[f"l{i}"] == (want if 0 <= want < size[r["code"]] else None)


@pytest.mark.parametrize("n_hist,expected", [(2, 0), (3, 0), (4, 2), (6, 6), (9, 12)])
def test_forecast_frame_short_series(spark, n_hist, expected):
    from panelcast.operators import forecast as FC
    vals = [10, 40, 15, 70, 20, 90, 35, 60, 25][:n_hist]
    feats = FC.forecast_features(_series(spark, vals, step=7), 5)
    assert feats.count() == expected          # 2n - 1 - N rows once n >= 4, else none


def test_score_with_unscaled_features(spark):
    from pyspark.ml.feature import SQLTransformer
    from panelcast.operators import forecast as FC
    vals = [10.0, 40.0, 15.0, 70.0, 20.0, 90.0, 35.0, 60.0]
    feats = FC.forecast_features(_series(spark, vals, step=7), 5)
    naive = SQLTransformer(statement="SELECT *, Y_001_day_before AS prediction FROM __THIS__")
    raw = FC.score_and_unscale(feats, naive, scale_for_model=False)
    hist = raw.orderBy("dt").limit(3).collect()
    # History rows 6..8 see the original values of rows 5..7 as their lag 1.
    assert [round(r["prediction"], 9) for r in hist] == [20.0, 90.0, 35.0]
    scaled = FC.score_and_unscale(feats, naive).orderBy("dt").limit(3).collect()
    assert [round(r["unscale_pred"], 9) for r in scaled] == [20.0, 90.0, 35.0]


def _hot_panel(spark):
    import random
    rnd = random.Random(9)
    rows = [("hot", D0 + dt.timedelta(days=i // 4), float(rnd.randint(5, 500)), i) for i in range(400)]
    for c in range(15):
        for j in range(rnd.randint(1, 12)):
            rows.append((f"s{c}", D0 + dt.timedelta(days=j), float(rnd.randint(5, 500)), 10000 + 100 * c + j))
    rows += [("flat", D0 + dt.timedelta(days=j), 7.0, 20000 + j) for j in range(5)]
    rows += [(None, D0 + dt.timedelta(days=j), float(rnd.randint(5, 500)), 30000 + j) for j in range(40)]
    return spark.createDataFrame(rows, "code string, dt date, Y double, o int")


@pytest.mark.parametrize("cyclic", [False, True])
def test_balanced_extrapolation_matches_window(spark, cyclic):
    panel = _hot_panel(spark)
    order = ("dt", "o")
    fn = (lambda s: X.cyclic_forecast_from_state(s, 700, order=order)) if cyclic \
        else (lambda s: X.forecast_from_state(s, 700))
    got = {}
    for strategy in ("window", "balanced"):
        state = X.scaled_series(panel, order=order, strategy=strategy)
        got[strategy] = {(r["code"], r["k"]): (r["dt"], r["log_y"]) for r in fn(state).collect()}
    assert got["window"].keys() == got["balanced"].keys() and got["window"]
    for k, (d, v) in got["window"].items():
        d2, v2 = got["balanced"][k]
        assert d == d2 and math.isclose(v, v2, rel_tol=1e-9, abs_tol=1e-9)


def test_forecast_keeps_the_sign_of_unscaled_values(spark):
    panel = _series(spark, [4.0, 3.0, -2.0])
    got = X.ratio_forecast(panel, scale=False).orderBy("k").collect()
    assert [r["Y"] for r in got] == [pytest.approx(-2.0 * 0.75), pytest.approx(-2.0 * 0.75)]
    zero = X.ratio_forecast(_series(spark, [4.0, 3.0, 0.0]), scale=False).collect()
    assert [r["Y"] for r in zero] == [0.0, 0.0]


def test_balanced_positional_mape(spark):
    from panelcast.operators import forecast as FC
    panel = _hot_panel(spark).drop("o").dropDuplicates(["code", "dt"])
    feats = FC.forecast_features(panel, 5).withColumn("prediction", F.col("Y_001_day_before"))
    a = {r["code"]: (r["mape"], r["n_scored"]) for r in FC.positional_mape(feats).collect()}
    b = {r["code"]: (r["mape"], r["n_scored"]) for r in
         FC.positional_mape(feats, strategy="balanced").collect()}
    assert a.keys() == b.keys() and a
    assert all(a[k][1] == b[k][1] and math.isclose(a[k][0], b[k][0], rel_tol=1e-12) for k in a)


def test_balanced_forward_fill(spark):
    import random
    rnd = random.Random(3)
    rows = [("hot", i, None if rnd.random() < 0.6 else float(i)) for i in range(500)]
    rows += [("b", i, None if i % 3 else float(i)) for i in range(20)]
    rows += [("c", i, None) for i in range(4)]
    df = spark.createDataFrame(rows, "code string, dt int, Y double")
    want = {(r["code"], r["dt"]): r["F"] for r in
            series.forward_fill(df, "Y", out="F").collect()}
    got = {(r["code"], r["dt"]): r["F"] for r in
           series.forward_fill(df, "Y", out="F", strategy="balanced").collect()}
    assert got == want


def test_bad_dates_raise_unless_asked_otherwise(spark):
    from panelcast.functions.labels import label_rows
    from panelcast.operators.panel import build_panel, clean_measurements, count_bad_dates
    raw = spark.createDataFrame([("1/2/2020", "s", "n", 1.0), ("2020-13-45", "s", "n", 2.0), ("x", "s", "n", 3.0)],
                                "time_key string, sites string, node_desc string, ds_load double")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            for fmt in ("M/d/yyyy", None):
                with pytest.raises(Exception, match="not a date"):
                    build_panel(raw, date_format=fmt).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
    assert build_panel(raw, date_format="M/d/yyyy", on_bad_date="null").count() == 1
    assert tuple(count_bad_dates(clean_measurements(raw), "M/d/yyyy").first()) == (3, 2)
    rows = spark.createDataFrame([("a", "20200101")], "code string, dt string")
    faults = spark.createDataFrame([("a", "2020/01/05")], "code string, fault_date string")
    kw = {"dt_format": "yyyyMMdd", "fault_format": "yyyy-MM-dd"}
    with pytest.raises(Exception, match="not a date"):
        label_rows(rows, faults, **kw).collect()
    assert label_rows(rows, faults, on_bad_date="null", **kw).first()["label"] == 0


def test_input_ordinal_follows_the_files(spark, tmp_dir):
    from panelcast.sources.readers import read_csv, with_input_ordinal
    want = []
    for name, n in (("a", 2), ("b", 9000), ("c", 300)):
        lines = [f"1/1/2020,{name},{i},1.0" for i in range(n)]
        want += [(name, str(i)) for i in range(n)]
        with open(f"{tmp_dir}/{name}.csv", "w") as f:
            f.write("time_key,sites,node_desc,ds_load\n" + "\n".join(lines) + "\n")
    got = read_csv(spark, tmp_dir, ordinal=True).orderBy("_ord").select("sites", "node_desc").collect()
    assert [tuple(r) for r in got] == want
    with pytest.raises(ValueError, match="tie-break"):
        with_input_ordinal(spark.range(3))


@pytest.mark.parametrize("strategy", ["window", "balanced"])
def test_forecast_sink_writes_one_file_per_series(spark, tmp_dir, strategy):
    import glob
    from pyspark.ml.feature import SQLTransformer
    from panelcast.operators import forecast as FC
    from panelcast.sources.sinks import read_forecast_csv, write_forecast_csv
    naive = SQLTransformer(statement="SELECT *, Y_001_day_before AS prediction FROM __THIS__")
    forecast = FC.panel_forecast(_hot_panel(spark), naive, horizon=30, strategy=strategy, order=("dt", "o"))
    path = write_forecast_csv(forecast, f"{tmp_dir}/{strategy}")
    codes = [r[0] for r in forecast.select("code").distinct().collect()]
    assert len(glob.glob(f"{path}/code=*/*.csv")) == len(codes)
    assert read_forecast_csv(spark, path).count() == forecast.count()
    split = write_forecast_csv(forecast, f"{tmp_dir}/{strategy}-3", pieces=3)
    assert read_forecast_csv(spark, split).count() == forecast.count()
