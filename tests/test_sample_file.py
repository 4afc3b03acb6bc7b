"""Golden test on the 32-row raw sample (dates M/d/yyyy, file starts with a BOM)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from panelcast.functions.calendar_features import CALENDAR_COLUMNS, add_calendar_features
from panelcast.operators import lags, split
from panelcast.operators.panel import build_panel
from panelcast.sources.readers import ORDINAL, RAW_DATE_FORMAT, read_csv

# The published 32-row sample.
SAMPLE = """﻿time_key,sites,node_desc,ds_load
2/4/2018,131,JC05,100.0008571
2/11/2018,131,JC05,90.60925246
2/25/2018,131,JC05,105.5016373
3/18/2018,131,JC05,118.6052447
3/25/2018,131,JC05,96.959175
4/15/2018,131,JC05,105.2282631
4/29/2018,131,JC05,111.2163436
5/6/2018,131,AZADA,122.0000749
2/4/2018,477,AZADA,100.0008571
2/4/2018,477,AZADA,90.60925246
2/4/2018,477,AZADA,105.5016373
2/4/2018,477,AZADA,118.6052447
2/4/2018,477,AZADA,96.959175
2/4/2018,477,AZADA,105.2282631
2/4/2018,477,AZADA,111.2163436
2/4/2018,477,AZADA,122.0000749
2/4/2018,333,LOL,100.0008571
2/4/2018,333,LOL,90.60925246
2/4/2018,333,LOL,105.5016373
2/4/2018,333,LOL,118.6052447
2/4/2018,333,LOL,96.959175
2/4/2018,333,LOL,105.2282631
2/4/2018,333,LOL,111.2163436
2/4/2018,333,LOL,122.0000749
2/4/2018,343,TEST,100.0008571
2/4/2018,343,TEST,90.60925246
2/4/2018,343,TEST,105.5016373
2/4/2018,343,TEST,118.6052447
2/4/2018,343,TEST,96.959175
2/4/2018,343,TEST,105.2282631
2/4/2018,343,TEST,111.2163436
2/4/2018,343,TEST,122.0000749
"""


def _panel(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sample.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(SAMPLE)
    raw = read_csv(spark, path, ordinal=True)
    return build_panel(raw, date_format=RAW_DATE_FORMAT, keep=(ORDINAL,))


def test_sample_counts(spark, tmp_dir):
    panel = _panel(spark, tmp_dir)
    counts = {r["code"]: r["count"] for r in panel.groupBy("code").count().collect()}
    assert counts == {"131JC05": 7, "131AZADA": 1, "477AZADA": 8, "333LOL": 8, "343TEST": 8}
    assert panel.where(F.col("code") == "477AZADA").select("dt").distinct().collect()[0][0] \
        == dt.date(2018, 2, 4)


def test_sample_lag_frame_and_split(spark, tmp_dir):
    panel = add_calendar_features(_panel(spark, tmp_dir))
    frame = lags.lag_frame(panel, 5, columns=["Y", *CALENDAR_COLUMNS], order=("dt", ORDINAL))
    frame = lags.label_from_lag0(lags.drop_sentinels(frame))
    rows = frame.select("code", "dt").collect()
    assert len(rows) == 11
    per_code = {}
    for r in rows:
        per_code.setdefault(r["code"], []).append(r["dt"])
    assert sorted(per_code["131JC05"]) == [dt.date(2018, 4, 15), dt.date(2018, 4, 29)]
    assert "131AZADA" not in per_code
    assert all(len(per_code[c]) == 3 for c in ("477AZADA", "333LOL", "343TEST"))
    # Ties on one date keep the input order: lag 1 of the 6th row is the 5th value.
    lz = (frame.where(F.col("code") == "477AZADA").orderBy("Y_001_day_before")
          .select("Y", "Y_001_day_before", "Y_005_day_before").collect())
    assert sorted((r["Y_005_day_before"], r["Y_001_day_before"], r["Y"]) for r in lz) == sorted([
        (100.0008571, 96.959175, 105.2282631),
        (90.60925246, 105.2282631, 111.2163436),
        (105.5016373, 111.2163436, 122.0000749)])

    b = split.split_bounds(frame).collect()[0]
    assert b["start_dt"] == dt.date(2018, 2, 4)
    assert b["total_days"] == 84 and b["train_days"] == 63
    assert b["train_end"] == dt.date(2018, 4, 8)
    train, test = split.time_split(frame)
    assert train.count() == 9 and test.count() == 2
    assert 65 == len([c for c in frame.columns if c not in ("Y", "code", "dt")])


def test_sample_forecast_keeps_input_order(spark, tmp_dir):
    from panelcast.operators import forecast as FC
    panel = _panel(spark, tmp_dir)
    got = {}
    for strategy in ("window", "balanced"):
        feats = FC.forecast_features(panel, 5, strategy=strategy, order=("dt", ORDINAL))
        got[strategy] = sorted((r["code"], r["seq"], r["Y"], r["Y_001_day_before"])
                               for r in feats.collect())
    assert got["window"] == got["balanced"]
    vals = [100.0008571, 90.60925246, 105.5016373, 118.6052447, 96.959175,
            105.2282631, 111.2163436, 122.0000749]
    lo, hi = min(vals), max(vals)
    scaled = [(3000 - 70) * (v - lo) / (hi - lo) + 70 for v in vals]
    hist = [r for r in got["window"] if r[0] == "477AZADA" and r[1] <= 8]
    # History rows 6..8 in input order, each with its input-order predecessor.
    assert [round(r[2], 9) for r in hist] == [round(v, 9) for v in scaled[5:8]]
    assert [round(r[3], 9) for r in hist] == [round(v, 9) for v in scaled[4:7]]
