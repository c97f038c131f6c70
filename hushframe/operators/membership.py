"""Black-box membership inference: can an attacker tell training rows from others?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.noise import uniform
from hushframe.operators import deep_forest
from hushframe.operators.joins import attach
from hushframe.operators.models import Scorer
from hushframe.operators.splits import balanced_sample
from hushframe.session import cut_lineage

# Fixed value: trees of the attack forest.
ATTACK_TREES = 100
# Bins of a probability, and distinct binned points that one task takes.
BINS, MERGED_POINTS = 32, 100_000


def attack_table(scorer: Scorer, train: DataFrame, test: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Class probabilities and true label of every row, with ``member`` 1 for training rows."""
    seen = lambda df, member: scorer(df).select(*keys, F.col(label).alias("label"), "prob", F.lit(member).alias("member"))
    return seen(train, 1).unionByName(seen(test, 0))


def attack_split(df: DataFrame, keys: Sequence[str], seed: str | int = 42) -> DataFrame:
    """Half of the members and of the non-members train the attack, the rest evaluate it."""
    return df.withColumn("is_eval", uniform(seed, F.lit("attack"), "member", *keys) < F.lit(0.5))


def _binned(table: DataFrame, classes: Sequence[float], bins: int) -> tuple[DataFrame, int]:
    """Adds ``_x``: the bin of every probability, then the one-hot label; and its width."""
    outputs = table.select(F.size("prob").alias("n")).first()
    width = outputs["n"] if outputs else 0
    points = [i / bins for i in range(1, bins)]
    half = table.filter(~F.col("is_eval"))
    found = half.agg(*[F.percentile_approx(F.col("prob")[i], points, 100 * bins).alias(f"q{i}") for i in range(width)]).first()
    bin_of = lambda i: sum([(F.col("prob")[i] > F.lit(q)).cast("double") for q in sorted(set(found[i] or []))], F.lit(0.0))
    hot = [F.when(F.col("label").cast("double") == F.lit(float(c)), 1.0).otherwise(0.0) for c in classes]
    return table.withColumn("_x", F.array(*[bin_of(i) for i in range(width)], *hot)), width + len(hot)


def forest_attack(
    table: DataFrame, classes: Sequence[float], seed: int = 42, trees: int = ATTACK_TREES, depth: int = 10, bins: int = BINS,
    merged_points: int = MERGED_POINTS,
) -> DataFrame:
    """Fit a forest on the attack half and add ``inferred`` to the evaluation half.

    A split sees a probability only as one of ``bins`` quantile bins, so rows of equal bins,
    label and membership are one point with their number: the rows are read to count points,
    the trees grow on points, and the rows to judge look their point up.  Where there
    are more points than ``merged_points``, Spark's forest is fitted on the rows.
    """
    binned, width = _binned(table, classes, bins)
    points = cut_lineage(binned.groupBy("is_eval", "_x", "member").agg(F.count(F.lit(1)).alias("n")))
    if points.count() > merged_points:
        return _row_forest_attack(table, classes, seed, trees, depth, bins)
    seen = points.filter(~F.col("is_eval")).select(F.col("_x").alias("x"), F.col("member").cast("double").alias("y"), "n")
    forest = deep_forest.fit_merged(seen, width, 2, trees, seed, depth=depth)
    asked = points.filter("is_eval").select("_x", array_to_vector("_x").alias("features")).distinct()
    judged = deep_forest.score_forest(asked, forest).select("_x", F.col("prediction").cast("int").alias("inferred"))
    return attach(binned.filter("is_eval"), judged, ["_x"]).select(*table.columns, "inferred")


def _row_forest_attack(table: DataFrame, classes: Sequence[float], seed: int, trees: int, depth: int, bins: int) -> DataFrame:
    """The same attack by Spark's forest over the rows."""
    hot = [F.when(F.col("label").cast("double") == F.lit(float(c)), 1.0).otherwise(0.0) for c in classes]
    rows = table.withColumn("attack_features", array_to_vector(F.concat("prob", F.array(*hot))))
    forest = RandomForestClassifier(
        featuresCol="attack_features", labelCol="member", predictionCol="inferred", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed
    ).fit(rows.filter(~F.col("is_eval")))
    out = forest.transform(rows.filter("is_eval"))
    return out.withColumn("inferred", F.col("inferred").cast("int")).drop("rawPrediction", "probability", "attack_features")


def threshold_attack(table: DataFrame, t: float) -> DataFrame:
    """Call a row a member when the model is at least this confident."""
    sure = F.round(F.array_max("prob"), 9) >= F.lit(float(t))
    return table.filter("is_eval").withColumn("inferred", sure.cast("int"))


def attack_accuracy(inferred: DataFrame, keys: Sequence[str], seed: str | int = 42) -> DataFrame:
    """Share of right calls on equally many members and non-members, so guessing scores one half."""
    even = balanced_sample(inferred, "member", ["member", *keys], seed)
    return even.agg(F.round(F.avg((F.col("inferred") == F.col("member")).cast("double")), 4).alias("attack_accuracy"))
