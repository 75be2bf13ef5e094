"""Demand model: feature assembly, boosted trees, scoring and error measures."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..session import cut_lineage
from .aggregate import ZONE
from .enrich import fill
from .scenarios import clip_negative

# Fills of the training frame.
TRAINING_FILLS = {
    "zone_baseline_avg": 1.0, "high_acuity_ratio": 0.23, "held_ratio": 0.06, "is_holiday": 0, "is_major_event": 0,
    "is_school_day": 0, "is_heat_emergency": 0, "is_extreme_heat": 0, "subway_disruption_idx": 0.5,
}


#: rows of the training table that a task takes at least
ROWS_PER_TASK = 20_000


def training_frame(bins: DataFrame, baselines: DataFrame, stats: DataFrame) -> DataFrame:
    """Zone bins with their baseline and zone ratios; both lookups are bounded
    by zones x hours x weekdays and broadcast."""
    b = baselines.filter(F.col(ZONE).isin(dim.ZONE_CODES)).select(ZONE, "hour", "dayofweek", "zone_baseline_avg")
    s = stats.filter(F.col(ZONE).isin(dim.ZONE_CODES)).select(ZONE, "high_acuity_ratio", "held_ratio")
    df = bins.join(F.broadcast(b), [ZONE, "hour", "dayofweek"], "left").join(F.broadcast(s), ZONE, "left")
    return fill(df, TRAINING_FILLS)


def leave_own_date_out(frame: DataFrame) -> DataFrame:
    """Training rows by date with the baseline of the other dates: the mean of (zone, hour, weekday) without the row itself.

    A baseline that contains the row's own count tells the trees part of the answer, which no test row has. Where there is
    no other date the fill of the frame takes its place. Other rows keep theirs. The dates per key (at most 5,208 rows) are
    broadcast.
    """
    keys, train = [ZONE, "hour", "dayofweek"], F.col("split") == "train"
    dates = frame.filter(train & F.col(ZONE).isin(dim.ZONE_CODES)).groupBy(*keys).agg(F.count("*").alias("_dates"))
    others = (F.col("zone_baseline_avg") * F.col("_dates") - F.col("incident_count")) / F.nullif(F.col("_dates") - 1, F.lit(0))
    own = F.when(train, F.coalesce(others, F.lit(TRAINING_FILLS["zone_baseline_avg"]))).otherwise(F.col("zone_baseline_avg"))
    return frame.join(F.broadcast(dates), keys, "left").withColumn("zone_baseline_avg", own).drop("_dates")


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=dim.FEATURES, outputCol="features").transform(df)


def train(
    frame: DataFrame, trees: int = 300, depth: int = 6, step: float = 0.05, sample: float = 0.8, seed: int = 42, patience: int = 20,
) -> GBTRegressionModel:
    """Boosted regression trees on ``incident_count``. The error on the test rows after each round decides how many of them
    stay: those up to the best round, once ``patience`` rounds bring no gain. A round's draws follow from the seed and its
    number alone, so fewer rounds grow the first of the same trees: ``trees`` are grown only if no shorter run settles it.

    Bins should have the grain of their baseline, a date's hour (``zone_bins`` with ``incident_date``): a monthly bin sums
    several dates, and trees that learn such sums miss single dates by as much.
    """
    data = _assembled(frame).select(
        "features", F.col("incident_count").cast("double").alias("label"), (F.col("split") == "test").alias("holdout")
    )
    # a tree is a few short jobs; tasks of few rows would cost more than they do
    data = cut_lineage(data)
    data = data.coalesce(max(1, min(data.rdd.getNumPartitions(), 1 + data.count() // ROWS_PER_TASK)))
    grower = GBTRegressor(
        maxDepth=depth, stepSize=step, subsamplingRate=sample, featureSubsetStrategy=str(sample), seed=seed,
        checkpointInterval=20, maxMemoryInMB=1024, cacheNodeIds=False,
    )
    learnt, holdout = data.where("not holdout"), data.where("holdout")
    if holdout.isEmpty():
        return grower.setMaxIter(trees).fit(learnt)
    for rounds in run_lengths(trees, patience):
        grown = grower.setMaxIter(rounds).fit(learnt)
        best = best_round(grown.evaluateEachIteration(holdout, "squared"), patience)
        if rounds == trees or best + patience <= rounds:
            return first_trees(grown, best)


def run_lengths(trees: int, patience: int) -> list[int]:
    """Rounds of the runs to try, each three times as long as the one before, so that all of them together take at most
    half as long again as the last; the last has ``trees`` rounds."""
    lengths = [trees]
    while lengths[0] // 3 > max(patience, 0):
        lengths.insert(0, lengths[0] // 3)
    return lengths


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model made of the first ``n`` trees and their weights."""
    if n >= model.getNumTrees:
        return model
    sc = SparkContext.getOrCreate()
    ml, grown, weights = sc._jvm.org.apache.spark.ml, model._java_obj.trees(), model._java_obj.treeWeights()
    some = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    shares = sc._gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        some[i], shares[i] = grown[i], weights[i]
    return GBTRegressionModel(ml.regression.GBTRegressionModel(model.uid, some, shares, model.numFeatures))


def best_round(errors: list[float], patience: int) -> int:
    """Number of rounds up to the least error seen before ``patience`` rounds without a gain."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def score(model: GBTRegressionModel, frame: DataFrame) -> DataFrame:
    """Adds ``predicted``, clipped at zero."""
    out = model.transform(_assembled(frame))
    return out.withColumn("predicted", clip_negative(F.col("prediction"))).drop("features", "prediction")


def feature_importance(spark, model: GBTRegressionModel) -> DataFrame:
    values = [float(v) for v in model.featureImportances.toArray()]
    table = dim.local_table(spark, list(zip(dim.FEATURES, values)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def forecast_error(scored: DataFrame, *keys: str) -> DataFrame:
    """RMSE and MAE of ``predicted`` against ``incident_count``, overall or by key."""
    gap = F.col("incident_count") - F.col("predicted")
    return scored.groupBy(*keys).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.count("*").alias("n")
    )


def residual_profile(scored: DataFrame, *keys: str) -> DataFrame:
    gap = F.col("incident_count") - F.col("predicted")
    return scored.groupBy(*keys).agg(F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("std"))


def baseline_only(frame: DataFrame) -> DataFrame:
    """Scores the frame with the bare baseline, the model every other must beat."""
    return frame.withColumn("predicted", F.col("zone_baseline_avg"))


def compare_scenarios(scored: DataFrame, label: str, changed: str, base: str, *keys: str) -> DataFrame:
    """Mean prediction of two labelled scenarios and their difference."""
    mean = {n: F.avg(F.when(F.col(label) == v, F.col("predicted"))) for n, v in (("changed", changed), ("base", base))}
    return scored.groupBy(*keys).agg(
        mean["base"].alias("mean_base"), mean["changed"].alias("mean_changed"),
        (mean["changed"] - mean["base"]).alias("delta"),
    )


def compare_cases(scored: DataFrame, label: str, changed: tuple[str, ...], base: str, *keys: str) -> DataFrame:
    """:func:`compare_scenarios` of several cases against one, in a single aggregate by keys and case."""
    means = scored.groupBy(*keys).agg(*[F.avg(F.when(F.col(label) == c, F.col("predicted"))).alias(f"m{i}") for i, c in enumerate((base, *changed))])
    rows = F.explode(F.array(*[
        F.struct(F.col("m0").alias("mean_base"), F.col(f"m{i + 1}").alias("mean_changed"), (F.col(f"m{i + 1}") - F.col("m0")).alias("delta"), F.lit(c).alias(label))
        for i, c in enumerate(changed)
    ]))
    return means.select(*keys, rows.alias("r")).select(*keys, "r.*")
