"""Model operators: structural checks (Spark's booster differs from the source's)."""

import random

import pytest

from panelcast.operators import ml


def _planted(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0, 10)
        rows.append(("k", i, 3.0 * a + 1.0, a, b, c))
    return spark.createDataFrame(rows, "code string, dt int, Y double, a double, b double, c double")


def test_importance_and_selector(spark):
    df = _planted(spark)
    feats = ["a", "b", "c"]
    assembled = ml.assembler(feats).transform(df)
    model = ml.gbt(max_iter=5, max_depth=3).fit(assembled)
    table = ml.importance_table(spark, model.featureImportances, assembled).collect()
    assert [r["name"] for r in table][0] == "a"
    assert abs(sum(r["score"] for r in table) - 1.0) < 1e-9

    top1 = ml.FeatureImpSelector(estimator=ml.gbt(max_iter=5, max_depth=3),
                                 numTopFeatures=1, outputCol="sub").fit(assembled)
    assert list(top1.getIndices()) == [0]
    assert top1.transform(assembled).first()["sub"].size == 1

    # Strict threshold: a score equal to the threshold is not kept.
    best = max(r["score"] for r in table)
    strict = ml.FeatureImpSelector(estimator=ml.gbt(max_iter=5, max_depth=3),
                                   selectorType="threshold", threshold=best).fit(assembled)
    assert list(strict.getIndices()) == []

    with pytest.raises(NameError):
        ml.FeatureImpSelector(estimator=ml.gbt(max_iter=2, max_depth=2),
                              selectorType="other").fit(assembled)


def test_selector_params():
    sel = ml.FeatureImpSelector()
    assert sel.getSelectorType() == "numTopFeatures"
    assert sel.getNumTopFeatures() == 20 and sel.getThreshold() == pytest.approx(0.01)
    assert sel.getOutputCol() == "features"
    sel.setParams(numTopFeatures=3)
    assert sel.getNumTopFeatures() == 3
    assert sel.setThreshold(0.2).getThreshold() == pytest.approx(0.2)


def test_defaults_follow_source_settings():
    est = ml.gbt()
    assert (est.getMaxIter(), est.getMaxDepth(), est.getStepSize()) == (27, 10, 0.18)
    assert ml.REFIT == {"maxIter": 29, "maxDepth": 10, "stepSize": 0.13}


def test_split_on_selection():
    ranked = [(2, 0.5), (0, 0.3), (1, 0.2), (3, 0.0)]
    assert ml.select_split_on(ranked) == [2, 0, 1]
    assert ml.select_split_on(ranked, 0.7) == [2, 0]
    assert ml.select_top(ranked, 2) == [2, 0]
    assert ml.select_threshold(ranked, 0.2) == [2, 0]


def test_pipeline_cv_save_load(spark, tmp_dir):
    df = _planted(spark, 200)
    cv = ml.cross_validator(["a", "b", "c"], ml.gbt(max_iter=2), depths=(2,), steps=(0.1, 0.4))
    model = cv.fit(df)
    assert len(model.avgMetrics) == 2
    path = ml.save_model(model, f"{tmp_dir}/cv")
    loaded = ml.load_cv_model(path)
    assert loaded.transform(df).count() == 200


def test_time_folds(spark):
    import datetime as dt
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(30)]
    out = {r["dt"]: r["fold"] for r in ml.mark_time_folds(
        spark.createDataFrame(rows, "dt date"), 3).collect()}
    assert sorted(set(out.values())) == [0, 1, 2]
    assert out[dt.date(2020, 1, 1)] == 0 and out[dt.date(2020, 1, 30)] == 2
    assert [out[dt.date(2020, 1, 1) + dt.timedelta(days=i)] for i in range(30)] == \
        [0] * 10 + [1] * 10 + [2] * 10


def test_patience_stops_a_planted_overfit(spark):
    rnd = random.Random(7)
    # The target is noise around one step: later trees fit the noise of the training rows.
    rows = [("k", i, (10.0 if a > 5 else 0.0) + rnd.gauss(0, 4), a, rnd.uniform(0, 10))
            for i, a in enumerate(rnd.uniform(0, 10) for _ in range(600))]
    df = spark.createDataFrame(rows, "code string, dt int, Y double, a double, b double")
    train, valid = df.where("dt < 300"), df.where("dt >= 300")
    est = ml.gbt(max_iter=20, max_depth=6, step_size=0.5)
    model, rounds, history = ml.fit_with_patience(train, ["a", "b"], est, {"train": train, "valid": valid}, "valid")
    assert rounds < 10
    booster, first = model.stages[-1], model.stages[0]
    errors = {(r["set"], r["round"]): r["rmse"] for r in history.collect()}
    assert len(errors) == 40
    for i, e in enumerate(booster.evaluateEachIteration(first.transform(valid), "squared"), start=1):
        assert errors["valid", i] == pytest.approx(e ** 0.5)
    kept = ml.first_rounds(booster, first.transform(valid), rounds)
    got = kept.selectExpr("sqrt(avg(pow(prediction - Y, 2)))").first()[0]
    assert got == pytest.approx(errors["valid", rounds])


def test_best_round():
    assert ml.best_round([5, 4, 3, 3.5, 3.2, 3.1, 3.3, 3.4, 1.0], patience=5) == 3
    assert ml.best_round([5, 4, 3, 3.5, 3.2, 2.0, 3.3], patience=5) == 6
    assert ml.best_round([1.0], patience=5) == 1


# --- trees as tables, boosting that stops, saved selectors, one-pass folds ---

def _assembled(spark, rows):
    df = spark.createDataFrame(rows, "Y double, a double, b double, valid boolean")
    return ml.assembler(["a", "b"]).transform(df)


def test_total_gain_of_a_hand_computed_tree(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    from panelcast.operators import trees

    # Four rows each at (0, 0), (0, 1), (1, 0), (1, 1): a halves the error first, b does the rest on one side.
    rows = [(y, a, b, False) for (y, a, b) in ((0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (10.0, 1.0, 0.0), (14.0, 1.0, 1.0)) for _ in range(4)]
    df = _assembled(spark, rows)
    model = DecisionTreeRegressor(labelCol="Y", maxDepth=2).fit(df)
    # Mean 6: error 4*(36+36+16+64) = 608. After a: sides (0, 0) and (10, 14) with error 4*(4+4) = 32. After b: 0.
    got = {r.name: (r.n_splits, r.total_gain) for r in trees.gain_table(model, ["a", "b"]).collect()}
    assert got == {"a": (1, pytest.approx(576)), "b": (1, pytest.approx(32))}
    assert [i for i, _ in trees.ranked_by_gain(model)] == [0, 1]
    nodes = trees.tree_nodes(model).collect()
    assert len(nodes) == 5 and sum(r.feature is None for r in nodes) == 3
    # The library's importances give each tree the same weight; total gain does not.
    gbt = ml.gbt(max_iter=3, max_depth=2).fit(df)
    assert trees.ranked_by_gain(gbt)[0][1] == pytest.approx(576)
    twice = trees.booster_of([model, model], [1.0, 0.5])
    assert twice.transform(df).selectExpr("max(prediction)").first()[0] == pytest.approx(21)


def _overfit(spark):
    rnd = random.Random(7)
    return [((10.0 if a > 5 else 0.0) + rnd.gauss(0, 4), a, rnd.uniform(0, 10), i >= 300)
            for i, a in enumerate(rnd.uniform(0, 10) for _ in range(600))]


def test_boosting_stops_fitting(spark, tmp_dir, monkeypatch):
    from panelcast.operators import boosting

    df = _assembled(spark, _overfit(spark))
    kw = {"valid_col": "valid", "rounds": 20, "depth": 6, "rate": 0.5, "patience": 4, "chunk": 3}
    done = boosting.boost(df, folder=f"{tmp_dir}/one", **kw)
    assert done.fitted == done.rounds + 4 < 20 and len(done.model.trees) == done.rounds + 1
    errors = {(r["set"], r["round"]): r.rmse for r in done.history.collect()}
    assert len(errors) == 2 * done.fitted
    got = done.model.transform(df.where("valid")).selectExpr("sqrt(avg(pow(prediction - Y, 2)))").first()[0]
    assert got == pytest.approx(errors["validation", done.rounds])
    # A run that is broken off goes on after its last written table, with the same result.
    fits, plain = [], boosting.DecisionTreeRegressor.fit

    def breaks(self, *args):
        fits.append(self.getMaxDepth())
        if len(fits) == 6:
            raise KeyboardInterrupt
        return plain(self, *args)

    monkeypatch.setattr(boosting.DecisionTreeRegressor, "fit", breaks)
    with pytest.raises(KeyboardInterrupt):
        boosting.boost(df, folder=f"{tmp_dir}/two", **kw)
    again = boosting.boost(df, folder=f"{tmp_dir}/two", **kw)
    assert {(r["set"], r["round"]): r.rmse for r in again.history.collect()} == pytest.approx(errors)
    assert len(fits) == 6 + again.fitted - 3 and fits.count(0) == 1
    saved = ml.save_model(again.model, f"{tmp_dir}/model")
    assert type(again.model).load(saved).transform(df).exceptAll(again.model.transform(df)).count() == 0


def test_unfitted_selector_is_saved_with_its_estimator(spark, tmp_dir):
    from pyspark.ml import Pipeline

    df = _planted(spark, 200)
    feats = ["a", "b", "c"]
    pipe = ml.selection_pipeline(feats, ml.gbt(max_iter=2, max_depth=2), ml.gbt(max_iter=2, max_depth=3, features_col="sub"), num_top=2)
    pipe.write().overwrite().save(f"{tmp_dir}/p")
    back = Pipeline.load(f"{tmp_dir}/p")
    sel = back.getStages()[1]
    assert (sel.getNumTopFeatures(), sel.getOutputCol(), sel.getEstimator().getMaxIter(), sel.uid) == (2, "sub", 2, pipe.getStages()[1].uid)
    a, b = (p.fit(df).transform(df).select("dt", "prediction").orderBy("dt").collect() for p in (pipe, back))
    assert a == b
    empty = ml.FeatureImpSelector(threshold=0.3, selectorType="threshold")
    empty.write().save(f"{tmp_dir}/s")
    loaded = ml.FeatureImpSelector.load(f"{tmp_dir}/s")
    assert loaded.getThreshold() == 0.3 and not loaded.isSet("estimator")
    # A whole cross-validation that holds it.
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    grid = ParamGridBuilder().addGrid(pipe.getStages()[1].numTopFeatures, [1, 2]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="Y"), numFolds=2, seed=1)
    cv.write().save(f"{tmp_dir}/cv")
    assert CrossValidator.load(f"{tmp_dir}/cv").fit(df).avgMetrics == pytest.approx(cv.fit(df).avgMetrics)


@pytest.mark.parametrize("fold_col", [None, "fold"])
def test_folds_in_one_pass_are_the_library_s(spark, fold_col):
    from pyspark.sql import functions as F

    df = _planted(spark, 300).withColumn("fold", F.col("dt") % 3).coalesce(1)
    cv = ml.cross_validator(["a", "b", "c"], ml.gbt(max_iter=2), depths=(1, 3), steps=(0.1, 0.4), fold_col=fold_col)
    want, got = cv.fit(df), ml.cross_validate_in_one_pass(cv, df)
    assert got.avgMetrics == pytest.approx(want.avgMetrics)
    a, b = ([r.prediction for r in m.transform(df).select("prediction").collect()] for m in (got, want))
    assert a == pytest.approx(b)
    if fold_col:
        with pytest.raises(Exception, match="not a fold"):
            ml.cross_validate_in_one_pass(cv, df.withColumn("fold", F.lit(3)))
        with pytest.raises(ValueError, match="have rows"):
            ml.cross_validate_in_one_pass(cv, df.withColumn("fold", F.col("fold") % 2))
