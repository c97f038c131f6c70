"""Feature preparation: fitted statistics on the driver, applied as expressions.

A fit leaves one number per numeric column, short category lists and the width of
every block on the driver.  Columns with more categories are encoded by a distributed
code table, so any number of them works.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.scalars import col
from hushframe.operators import ranks
from hushframe.operators.clean import feature_roles
from hushframe.operators.joins import attach
from hushframe.session import cut_lineage, stage

# Category lists of at most this many values in all are kept as lists, longer columns as a code table.
LISTED = 10_000


def medians(df: DataFrame, cols: Sequence[str], exact_rows: int = ranks.EXACT_ROWS) -> dict[str, float | None]:
    return ranks.column_medians(df, cols, exact_rows)


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, ties to the smallest; one shuffle for all columns."""
    if not cols:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    counts = (
        df.select(cells.alias("c")).select("c.i", "c.v").filter(F.col("v").isNotNull())
        .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b")).collect()
    found = {r["i"]: r["b"]["v"] for r in best}
    return {c: found.get(i) for i, c in enumerate(cols)}


def impute_median(df: DataFrame, cols: Sequence[str], stats: dict[str, float | None] | None = None) -> DataFrame:
    stats = medians(df, cols) if stats is None else stats
    return df.select(*[F.coalesce(col(c).cast("double"), F.lit(stats[c])).alias(c) if c in stats else col(c) for c in df.columns])


def impute_mode(df: DataFrame, cols: Sequence[str], stats: dict[str, str | None] | None = None) -> DataFrame:
    stats = modes(df, cols) if stats is None else stats
    return df.select(*[F.coalesce(col(c).cast("string"), F.lit(stats[c])).alias(c) if c in stats else col(c) for c in df.columns])


def scales(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps deviation 1."""
    if not cols:
        return {}
    row = df.agg(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Sequence[str], stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    stats = scales(df, cols) if stats is None else stats
    return df.select(
        *[((col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) if c in stats else col(c) for c in df.columns]
    )


def _category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column with their rows: ``_g`` (the column's place), ``_v``, ``_n``."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    found = df.select(cells.alias("c")).select(F.col("c.i").alias("_g"), F.col("c.v").alias("_v")).filter(F.col("_v").isNotNull())
    return found.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))


def _numbered(counts: DataFrame) -> DataFrame:
    """Adds ``_code``, the position of a value among its column's sorted values, by range partitions."""
    ones = counts.select("_g", "_v", "_n", F.lit(1).alias("_one"))
    return ranks.running_total(ones, ["_g"], ["_v"], ["_one"]).select(
        "_g", "_v", "_n", F.col("before__one").cast("bigint").alias("_code")
    )


def one_hot(df: DataFrame, c: str, values: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Wide 0/1 columns ``<prefix>_<value>``; an unseen or missing value is all zeros.

    The values become column names, so they are read by the driver as any schema is.
    """
    if values is None:
        values = sorted(r["_v"] for r in _category_counts(df, [c]).select("_v").collect())
    hit = lambda v: F.coalesce((col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
    return df.select("*", *[hit(v).alias(f"{prefix or c}_{v}") for v in values])


def label_encode(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Position of the value among the sorted distinct values, from 0.

    The distinct values are numbered by range partitions, so any number of them
    works; the numbers come back by a checked lookup join.
    """
    name = name or f"{c}_code"
    numbered = _numbered(_category_counts(df, [c])).select("_v", "_n", F.col("_code").alias(name))
    return attach(df.withColumn("_v", col(c).cast("string")), numbered, ["_v"], how="left", weight="_n").drop("_v", "_n")


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """``y``, ``n``, ``weight`` = rows / (classes * rows of the class)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    share = (total["n"] or 0) / max(total["k"], 1)
    return counts.withColumn("weight", F.lit(share) / F.col("n"))


def with_class_weights(df: DataFrame, y: str, name: str = "weight") -> tuple[DataFrame, int]:
    """Rows with their balanced class weight, one CASE branch per class, and the number of rows."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()
    total, weight = sum(r["n"] for r in counts), F.lit(1.0)
    for r in sorted(counts, key=lambda r: (r[y] is not None, r[y])):
        weight = F.when(col(y) == F.lit(r[y]), F.lit(total / len(counts) / r["n"])).otherwise(weight)
    return df.withColumn(name, weight), total


@dataclass
class FeatureSet:
    """Fitted preparation: medians, scales, modes and category lists."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    # per text column: its sorted values, or only their number when a code table has them
    categories: dict[str, list[str]] = field(default_factory=dict)
    widths: dict[str, int] = field(default_factory=dict)
    codes: DataFrame | None = None

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(self.widths.values())

    @property
    def names(self) -> list[str]:
        """Names of the vector's entries; a column with a code table names them by their codes."""
        blocks = [self.categories.get(c) or range(self.widths[c]) for c in self.categorical]
        return self.numeric + [f"{c}_{v}" for c, block in zip(self.categorical, blocks) for v in block]

    def columns(self, df: DataFrame) -> DataFrame:
        """Imputed and scaled numeric columns, imputed text columns."""
        df = impute_mode(impute_median(df, self.numeric, self.medians), self.categorical, self.modes)
        return standardize(df, self.numeric, self.scales)

    def apply(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the feature vector: numeric block, then one-hot blocks (sparse)."""
        out = self.columns(df)
        blocks = list(self.numeric)
        for i, c in enumerate(self.categorical):
            width = self.widths[c]
            if not width:
                continue
            encoder = OneHotEncoder(inputCol=f"_i{i}", outputCol=f"_h{i}", dropLast=True)
            # one slot more for unseen values, and that last slot is the dropped one
            if c in self.categories:
                out = StringIndexerModel.from_labels(self.categories[c], c, f"_i{i}", handleInvalid="keep").transform(out)
                out = encoder.fit(out).transform(out)
            else:
                table = self.codes.filter(F.col("_g") == i).select("_v", "_n", "_code")
                out = attach(out.withColumn("_v", col(c).cast("string")), table, ["_v"], how="left", weight="_n")
                code = F.coalesce(F.col("_code").cast("double"), F.lit(float(width)))
                out = out.withColumn(f"_i{i}", code).drop("_v", "_n", "_code")
                out = encoder.fit(df.sparkSession.createDataFrame([(float(width),)], f"_i{i} double")).transform(out)
            blocks.append(f"_h{i}")
        safe = {c: f"_n{i}" for i, c in enumerate(self.numeric)}
        out = out.select("*", *[col(c).alias(safe[c]) for c in self.numeric])
        inputs = [safe.get(b, b) for b in blocks]
        out = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep").transform(out)
        return out.drop(*[c for c in out.columns if c in inputs or c.startswith("_i")])


def fit_features(train: DataFrame, target: str | None = None, skip: Sequence[str] = ()) -> FeatureSet:
    """Fit on the training rows; ``skip`` names keys and tags that are no features."""
    numeric, categorical = feature_roles(train.drop(*skip), target)
    fs = FeatureSet(numeric, categorical)
    fs.medians = medians(train, numeric)
    fs.modes = modes(train, categorical)
    filled = impute_mode(impute_median(train, numeric, fs.medians), categorical, fs.modes)
    fs.scales = scales(filled, numeric)
    if categorical:
        counts = cut_lineage(_category_counts(filled, categorical))
        widths = {r["_g"]: r["n"] for r in counts.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
        fs.widths = {c: widths.get(i, 0) for i, c in enumerate(categorical)}
        room, short = LISTED, []
        for i in sorted(range(len(categorical)), key=lambda i: (widths.get(i, 0), i)):
            room -= widths.get(i, 0)
            if room >= 0:
                short.append(i)
        lists: dict[int, list[str]] = {i: [] for i in short}
        for r in counts.filter(F.col("_g").isin(short)).select("_g", "_v").collect():
            lists[r["_g"]].append(r["_v"])
        fs.categories = {categorical[i]: sorted(v) for i, v in lists.items()}
        if len(short) < len(categorical):
            fs.codes = stage(_numbered(counts.filter(~F.col("_g").isin(short))))
    return fs
