"""Descriptive statistics, correlations and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge.functions import expressions as X
from fleetgauge.operators.ordered import average_ranks, quantiles, running_totals
from fleetgauge.sources.shared import write_shared


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row, one column: the exact quantile with linear interpolation."""
    return quantiles(df, column, [q]).select("value")


def churn_bounds(df: DataFrame, column: str = "code_churn_score") -> DataFrame:
    """5th and 95th percentile of churn, the source of the normalisation bounds."""
    value = F.col("value")
    return quantiles(df, column, [0.05, 0.95]).agg(
        F.max(F.when(F.col("q") == 0.05, value)).alias("churn_min"),
        F.max(F.when(F.col("q") == 0.95, value)).alias("churn_max"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, sample deviation, minimum and maximum."""
    return df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    ).withColumn("median", quantile(df, column, 0.5).scalar())


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(X.rows().alias("n"))
    if normalize:
        total = counts.agg(F.sum("n")).scalar()
        counts = counts.withColumn("share", X.ratio(F.col("n"), total))
    return counts.orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` against the given ``values`` of ``column``."""
    return df.groupBy(row).pivot(column, list(values)).agg(X.rows()).fillna(0)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts over equal-width bins from minimum to maximum, the last one closed.

    Empty bins are left out. If all values are equal, the range is one unit
    around them.
    """
    value = F.col(column).cast("double")
    low, high = F.col("_range.low"), F.col("_range.high")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.select(
        F.struct(
            F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("low"),
            F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("high"),
        )
    )
    width = (high - low) / F.lit(bins)
    place = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    return (
        df.where(value.isNotNull())
        .withColumn("_range", ends.scalar())
        .select(place.alias("bin"), low.alias("_low"), width.alias("_width"))
        .groupBy("bin", "_low", "_width")
        .agg(X.rows().alias("n"))
        .select(
            "bin",
            (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
            (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("bin_end"),
            "n",
        )
        .orderBy("bin")
    )


def group_mean(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(column).alias("mean")).orderBy(group)


def group_quantiles(df: DataFrame, group: str, column: str) -> DataFrame:
    """Minimum, quartiles and maximum of each of a few groups, such as tiers."""
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    long = quantiles(df, column, list(names), by=[group])
    wide = [
        F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in names.items()
    ]
    return long.groupBy(group).agg(*wide).orderBy(group)


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))


def signal_audit(
    df: DataFrame,
    features: Sequence[str] = tuple(S.PRE_DEPLOYMENT_FEATURES),
    target: str = "error_rate_per_10k",
    drop_booleans: bool = False,
    complete: bool = False,
) -> DataFrame:
    """Spearman correlation of each feature with the target, strongest first.

    Booleans enter as 0 and 1 unless dropped. Rows lacking either value are left
    out feature by feature, so the target is ranked once per feature; with
    ``complete`` rows lacking any value are left out and it is ranked once.

    The correlation is that of average ranks. Target ranks are summed per
    distinct feature value first, so feature ranks need no join with the rows.
    Runs jobs: the columns used, and then these with the target's ranks, are written to
    the shared folder, so that ``df`` is computed once however many passes ranks take.
    """
    kinds = dict(df.dtypes)
    used = [c for c in features if c in kinds and not (drop_booleans and kinds[c] == "boolean")]
    wide = df.select(
        F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in used]
    ).where("y is not null")
    wide = write_shared(wide.dropna() if complete else wide)

    def long(rows: DataFrame, *kept: str) -> DataFrame:
        entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in used]
        return rows.select(*kept, F.explode(F.array(*entries)).alias("_e")).select(*kept, "_e.*")

    rank = F.col("avg_rank").alias("ry")
    if complete:
        pairs = long(write_shared(wide.join(average_ranks(wide, "y").select("y", rank), "y")), "ry")
    else:
        pairs = long(wide, "y").where("x is not null")
        targets = average_ranks(pairs, "y", ["feature"]).select("feature", "y", rank)
        pairs = write_shared(pairs.join(targets, ["feature", "y"]))
    per_value = pairs.groupBy("feature", "x").agg(
        X.rows().alias("n"), F.sum("ry").alias("ry"), F.sum(F.col("ry") * F.col("ry")).alias("yy")
    )
    rank_x = F.col("n_before") + (F.col("n") + 1) / 2
    sums = (
        running_totals(per_value, "x", ["n"], ["feature"])
        .groupBy("feature")
        .agg(
            F.sum("n").alias("total"),
            F.sum(rank_x * F.col("ry")).alias("xy"),
            F.sum(F.col("n") * rank_x * rank_x).alias("xx"),
            F.sum("yy").alias("yy"),
        )
    )
    # The mean of average ranks is the middle rank.
    shift = F.col("total") * F.pow((F.col("total") + 1) / 2, F.lit(2.0))
    spread = F.sqrt((F.col("xx") - shift) * (F.col("yy") - shift))
    rho = F.try_divide(F.col("xy") - shift, spread)
    return sums.select("feature", rho.alias("spearman")).orderBy(F.desc("spearman"), "feature")


def cumulative_share(df: DataFrame, score: str) -> DataFrame:
    """Running share of the score total from the highest score down.

    One row per distinct score: how many rows have it, how many have it or a
    higher one, and the percentage of the total these add up to. NaN is no part of the
    total; its row comes last and has no rank and no percentage.
    """
    value = F.col(score)
    missing = F.isnan(value)
    nan = df.where(missing).groupBy(score).agg(X.rows().alias("n"))
    counts = df.where(value.isNotNull() & ~missing).groupBy(score).agg(X.rows().alias("n"))
    counts = counts.withColumn("_sum", F.col("n") * value)
    total = counts.agg(F.sum("_sum")).scalar()
    ran = running_totals(counts, score, ["n", "_sum"], descending=True)
    share = F.try_divide(F.col("_sum_before") + F.col("_sum"), total) * 100
    placed = ran.select(
        score,
        "n",
        (F.col("n_before") + F.col("n")).alias("rank"),
        share.alias("cumulative_pct"),
    )
    return placed.unionByName(nan, allowMissingColumns=True).orderBy(F.isnan(value), F.desc(score))


def feature_summary(patches: DataFrame) -> DataFrame:
    """Rows, date span, mean error rate, hotfix share and RMA total."""
    hotfixes = F.sum(F.col("is_hotfix").cast("int"))
    return patches.agg(
        X.rows().alias("versions"),
        F.min("release_date").alias("first_release"),
        F.max("release_date").alias("last_release"),
        F.datediff(F.max("release_date"), F.min("release_date")).alias("span_days"),
        F.avg("error_rate_per_10k").alias("mean_error_rate"),
        hotfixes.alias("hotfixes"),
        X.percent(hotfixes, X.rows()).alias("hotfix_pct"),
        F.sum("rmas").alias("total_rmas"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def out_of_order(df: DataFrame, line: str, seq: str, date: str) -> DataFrame:
    """Number of steps back in ``date`` when each line is read in order of ``seq``.

    Blocks of ``seq`` keep the windows small. Inside a block neighbours are
    compared; between blocks the last date of one meets the first of the next.
    """
    block = F.floor(F.col(seq) / F.lit(1 << 20)).alias("_block")
    rows = df.select(line, seq, date, block)
    inside = rows.withColumn(
        "_before", F.lag(date).over(W.partitionBy(line, "_block").orderBy(seq))
    ).select(date, "_before")
    edges = rows.groupBy(line, "_block").agg(
        F.min_by(date, seq).alias(date), F.max_by(date, seq).alias("_end")
    )
    between = edges.withColumn(
        "_before", F.lag("_end").over(W.partitionBy(line).orderBy("_block"))
    ).select(date, "_before")
    return inside.unionByName(between).agg(
        F.count_if(F.col(date) < F.col("_before")).alias("steps_back")
    )


def _violations(patches: DataFrame) -> dict[str, Column]:
    """Aggregates that count the offending values of each check but that of the dates."""
    rate, rma = F.col("error_rate_per_10k"), F.col("rma_rate")
    nulls: Column = sum((F.count_if(F.col(c).isNull()) for c in patches.columns), F.lit(0))
    return {
        "no_nulls": nulls,
        "error_rate_positive": F.count_if(~F.coalesce(rate > 0, F.lit(False))),
        "rma_rate_in_unit_range": F.count_if(~F.coalesce(rma.between(0, 1), F.lit(False))),
    }


def write_checked(patches: DataFrame, path: str) -> dict[str, int]:
    """Write patches and check them on the same pass: rows, distinct versions (estimated), high
    risk rows where there is such a flag, and the violations of ``quality_report``.

    The order of dates needs other passes and is not among them.
    """
    seen = {**_violations(patches), "rows": X.rows(), "versions": F.approx_count_distinct("firmware_version", 0.01)}
    if "high_risk_flag" in patches.columns:
        seen["n_high_risk"] = F.count_if(F.col("high_risk_flag") == 1)
    observed = Observation()
    watched = patches.observe(observed, *[F.coalesce(c, F.lit(0)).alias(name) for name, c in seen.items()])
    watched.write.mode("overwrite").parquet(path)
    return observed.get


def quality_report(patches: DataFrame, line: str = "product_line", seq: str = "release_seq") -> DataFrame:
    """Checks by name, with the number of offending values and whether they passed."""
    violations = _violations(patches)
    found, checks = patches.agg(*[c.alias(name) for name, c in violations.items()]), list(violations)
    order = out_of_order(patches, line, seq, "release_date")
    long = found.unpivot([], checks, "check", "violations").unionByName(
        order.select(F.lit("dates_in_order").alias("check"), F.col("steps_back").alias("violations"))
    )
    return long.withColumn("passed", F.col("violations") == 0).orderBy("check")
