"""The histogram booster against a plain one that works on single rows."""

import math
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleetgauge.operators import boosting
from fleetgauge.operators.boosting import LOGISTIC, SQUARED, Options
from fleetgauge.operators.sampling import bottom_k
from fleetgauge.plans import models

FEATURES = ["a", "b", "c"]


def table(spark, n, seed, classes=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    y = 3 * x[:, 0] + np.abs(x[:, 1]) * (x[:, 2] > 0) + rng.normal(size=n)
    if classes:
        y = (y > 1).astype(float)
    rows = [(i, *[None if rng.random() < 0.03 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(5), rows


def plain(rows, borders, options, leave_out=None, folds=5):
    """Losses by round and the trees, row by row."""
    bins = [[0 if v is None else 1 + sum(b < v for b in own) for v, own in zip(r[1:4], borders)] for r in rows]
    y, side = [r[4] for r in rows], ["out" if r[0] % folds == leave_out else "held" if r[0] % 7 == 3 else "fit" for r in rows]
    fit = [i for i, s in enumerate(side) if s == "fit"]
    mean = sum(y[i] for i in fit) / len(fit)
    start = mean if options.loss == SQUARED else math.log(mean / (1 - mean))
    margin, losses, trees = [start] * len(rows), [], []

    def slope(i):
        if options.loss == SQUARED:
            return margin[i] - y[i], 1.0
        p = 1 / (1 + math.exp(-margin[i]))
        return p - y[i], p * (1 - p)

    def loss():
        own = [i for i, s in enumerate(side) if s == "held"]
        if options.loss == SQUARED:
            return sum((y[i] - margin[i]) ** 2 for i in own) / len(own)
        return sum(math.log(1 + math.exp(-margin[i] if y[i] else margin[i])) for i in own) / len(own)

    def grow(own, slopes, level):
        g, h = sum(slopes[i][0] for i in own if i in slopes), sum(slopes[i][1] for i in own if i in slopes)
        score = lambda a, b: a * a / (b + boosting.SMOOTHING)
        best = (1e-9, None)
        if level < options.depth:
            for f in range(3):
                for cut in range(boosting.BINS - 1):
                    left = [i for i in own if i in slopes and bins[i][f] <= cut]
                    gl, hl = sum(slopes[i][0] for i in left), sum(slopes[i][1] for i in left)
                    if hl >= boosting.LEAST and h - hl >= boosting.LEAST:
                        gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut))
        if best[1] is None:
            return {i: -options.step * g / (h + boosting.SMOOTHING) for i in own}
        f, cut = best[1]
        return grow([i for i in own if bins[i][f] <= cut], slopes, level + 1) | grow([i for i in own if bins[i][f] > cut], slopes, level + 1)

    for _ in range(options.rounds):
        losses.append(loss())
        best = losses.index(min(losses))
        if options.patience and len(losses) - 1 - best >= options.patience:
            break
        moved = grow(range(len(rows)), {i: slope(i) for i in fit}, 0)
        trees.append(moved)
        margin = [m + moved[i] for i, m in enumerate(margin)]
    else:
        losses.append(loss())
    return losses


@pytest.mark.parametrize("loss", [SQUARED, LOGISTIC])
def test_losses_equal_a_plain_booster(spark, monkeypatch, loss):
    """Over several tasks and several jobs, with one fold left out and with all rows."""
    monkeypatch.setattr(boosting, "CELLS", 40)
    monkeypatch.setattr(boosting, "ROUNDS_A_JOB", 3)
    monkeypatch.setattr(boosting, "BINS", 8)
    df, rows = table(spark, 150, 1, loss == LOGISTIC)
    borders, options = boosting.bin_borders(df, FEATURES), Options(loss, 8, 0.5, 3, None)
    fitted = boosting.fit_ensembles(df, FEATURES, borders, "y", options, F.col("id") % 5, 5, F.col("id") % 7 == 3)
    assert len(fitted) == 6
    assert fitted[5].losses == pytest.approx(plain(rows, borders, options))
    assert fitted[2].losses == pytest.approx(plain(rows, borders, options, leave_out=2))


def test_each_model_stops_ten_rounds_after_its_best(spark):
    df, rows = table(spark, 400, 2)
    borders, options = boosting.bin_borders(df, FEATURES), Options(SQUARED, 1000, 0.5, 4, 10)
    for model in boosting.fit_ensembles(df, FEATURES, borders, "y", options, F.col("id") % 4, 4, F.col("id") % 7 == 3):
        best = model.losses.index(min(model.losses))
        assert len(model.losses) - 1 - best == 10 and len(model.leaves) == best and best > 0


def test_a_level_over_several_blocks_takes_no_second(spark, monkeypatch):
    """60 exchanges, which a barrier stage takes a minute for; the same trees as in one task."""
    df, _ = table(spark, 400, 5)
    borders, options = boosting.bin_borders(df, FEATURES), Options(SQUARED, 12, 0.5, 5, None)
    one = boosting.fit_ensembles(df, FEATURES, borders, "y", options)[0]
    monkeypatch.setattr(boosting, "CELLS", 100)
    began = time.monotonic()
    several = boosting.fit_ensembles(df, FEATURES, borders, "y", options)[0]
    assert time.monotonic() - began < 40
    assert len(several.leaves) == 12 and np.allclose(several.leaves, one.leaves)


def test_missing_values_no_rows_and_one_value(spark):
    df, _ = table(spark, 30, 3)
    options = Options(SQUARED, 3, 0.5, 2, 10)
    none = boosting.fit_ensembles(df.limit(0), FEATURES, boosting.bin_borders(df.limit(0), FEATURES), "y", options)
    assert len(none) == 1 and len(none[0].leaves) == 0
    same = df.select("id", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(float("nan")).alias("c"), F.lit(5.0).alias("y"))
    borders = boosting.bin_borders(same, FEATURES)
    model = boosting.fit_ensembles(same.union(same.withColumn("y", F.lit(None).cast("double"))), FEATURES, borders, "y", options)[0]
    assert model.start == 5.0 and np.allclose(model.leaves, 0)
    assert boosting.BoostedTrees.of(FEATURES, borders, SQUARED, model).transform(same).select("prediction").distinct().first()[0] == 5.0


def test_margins_by_rows_equal_those_of_the_fit(spark, tmp_path):
    """Scores of single rows give the loss that the cells gave, also after saving."""
    df, _ = table(spark, 500, 4, classes=True)
    borders, options = boosting.bin_borders(df, FEATURES), Options(LOGISTIC, 20, 0.3, 3, None)
    model = boosting.fit_ensembles(df, FEATURES, borders, "y", options, held=F.col("id") % 7 == 3)[0]
    trees = PipelineModel([boosting.BoostedTrees.of(FEATURES, borders, LOGISTIC, model)])
    trees.write().save(str(tmp_path / "m"))
    scored = PipelineModel.load(str(tmp_path / "m")).transform(df).where("id % 7 = 3")
    p = F.element_at(vector_to_array(F.col("probability")), 2)
    loss = scored.select(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p)))).first()[0]
    assert loss == pytest.approx(model.losses[-1])
    assert trees.stages[0].featureImportances.toArray().sum() == pytest.approx(1.0)


def test_folds_are_scored_by_models_that_never_saw_them(spark, sf):
    from fleetgauge.sources import fixtures as V

    rows = models.add_label(V.patch_features(spark, sf))
    for label, loss, low, high in (("label", LOGISTIC, 0.9, 1.0), ("error_rate_per_10k", SQUARED, 0.0, None)):
        found = models.cross_validate_boosted(rows, "firmware_version", label, loss, folds=3, rounds=40).collect()
        assert [r.fold for r in sorted(found)] == [0, 1, 2] and sum(r.n for r in found) == rows.count()
        spread = rows.agg(F.stddev_pop("error_rate_per_10k")).first()[0]
        assert all(low <= r.metric <= (high or 0.47 * spread) and 0 < r.rounds <= 40 for r in found)


@pytest.mark.parametrize("k", [0, 1, 37, 300, 1000])
def test_bottom_k_equals_a_sort(spark, k):
    df = spark.range(300).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 50).alias("s"))
    df = df.withColumn("s", F.when(F.col("id") % 40 != 0, F.col("s")))
    expected = [r.id for r in df.orderBy(F.asc_nulls_last("s"), "id").limit(k).collect()]
    assert sorted(r.id for r in bottom_k(df, F.col("s"), "id", k).collect()) == sorted(expected)


@pytest.mark.parametrize("loss", [SQUARED, LOGISTIC])
def test_a_grid_gives_the_trees_of_single_cells(loss):
    rng = np.random.default_rng(11)
    bins = np.unique(rng.integers(0, 7, (3, 600)).astype(np.uint8) * 3, axis=1)
    n, held = rng.integers(0, 9, bins.shape[1]).astype(float), rng.integers(0, 3, bins.shape[1]).astype(float)
    high = bins[0] + rng.normal(size=bins.shape[1]) * 5 > bins[1]
    arrays = [bins, n, np.where(high, n, 0.0), held, np.where(high, held, 0.0), np.where(high, held, 0.0), np.zeros(bins.shape[1])]
    found = []
    for kind in (boosting.Alone, boosting.Grid):
        cells = kind(*arrays)
        log = boosting._rounds(cells, Options(loss, 9, 0.3, 4, None), 0, 0, [{"losses": [], "active": True}])
        found.append((log["trees"][0], log["losses"][0], cells.margins()))
    for (f, b, leaves), (g, c, others) in zip(found[0][0], found[1][0], strict=True):
        assert f == g and b == c and np.allclose(leaves, others)
    assert np.allclose(found[0][1], found[1][1]) and np.allclose(found[0][2], found[1][2])


def test_rounds_on_many_cells_run_no_job_each(spark, monkeypatch):
    """Above 50,000 cells each level of a tree was a job: 5 a round, 0.2 seconds at least."""
    columns = {c: F.rand(i) * 1000 for i, c in enumerate(FEATURES)}
    df = spark.range(60_000).select("id", *[v.alias(c) for c, v in columns.items()]).withColumn("y", F.col("a") + F.rand(9) * 300)
    borders, options = boosting.bin_borders(df, FEATURES), Options(SQUARED, 30, 0.1, 5, None)
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        model = boosting.fit_ensembles(df, FEATURES, borders, "y", options)[0]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.leaves) == 30 and jobs < 30


def test_folds_are_scored_by_cell_as_by_row(spark):
    columns = {c: F.floor(F.rand(i) * 6) for i, c in enumerate(models.S.RISK_FEATURES)}
    df = spark.range(800).select(F.col("id").cast("string").alias("firmware_version"), *[v.alias(c) for c, v in columns.items()])
    df = df.withColumn("y", F.col("code_churn_score") * 3.0 + F.rand(9)).localCheckpoint()
    found = {r.fold: r for r in models.cross_validate_boosted(df, "firmware_version", "y", SQUARED, 2, 20, 0.3).collect()}
    fold = F.floor(models._share("firmware_version", models.S.SEED + 2) * 2)
    borders, held = boosting.bin_borders(df, models.S.RISK_FEATURES), models._share("firmware_version", models.S.SEED + 1) < models.VALIDATION
    fitted = boosting.fit_ensembles(df, models.S.RISK_FEATURES, borders, "y", Options(SQUARED, 20, 0.3, models.DEPTH, models.PATIENCE), fold, 2, held)
    for m in (0, 1):
        own = df.where(fold == m).withColumn("p", boosting.margin_column(models.S.RISK_FEATURES, borders, fitted[m]))
        n, rmse = own.agg(F.count("*"), F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2))).first()
        assert found[m].n == n and found[m].metric == pytest.approx(rmse) and found[m].rounds == len(fitted[m].leaves)
