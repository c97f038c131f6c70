"""Feature preparation under differential privacy: a ledger, noisy histograms, noisy moments.

Every statistic that a preparation learns from private rows is released with noise and
booked in a ledger, so preparation and fit together spend what the caller asked for.
Bounds of numeric columns are public.  Medians come from a histogram over an even public
grid (one row changes one cell by one, empty cells get noise too), means and scales from
noisy counts, sums and sums of squares around the middle of the bounds, categories from
noisy counts of a public list.  Modes and imputed values follow from these and cost nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.noise import fresh_seed, laplace, laplace_value, uniform, uniform_value
from hushframe.functions.scalars import col
from hushframe.operators.anonymize import finite
from hushframe.operators.clean import feature_roles
from hushframe.operators.features import FeatureSet

# Cells of a median's grid.
CELLS = 1024
MIN_VARIANCE = 1e-9


@dataclass
class Ledger:
    """What may be spent in total, and what has been, by name."""

    total: float
    spent: list[tuple[str, float]] = field(default_factory=list)

    @property
    def left(self) -> float:
        return self.total - sum(e for _, e in self.spent)

    def spend(self, name: str, epsilon: float) -> float:
        """Books ``epsilon``; a release beyond the total is refused before it is made."""
        if not epsilon > 0:
            raise ValueError(f"{name}: epsilon must be > 0")
        # a hair of rounding is not an overdraft
        if epsilon > self.left * (1 + 1e-9):
            raise ValueError(f"{name} asks for {epsilon:g}, only {self.left:g} of {self.total:g} is left")
        self.spent.append((name, epsilon))
        return epsilon

    def rest(self, name: str) -> float:
        """Books all that is left."""
        return self.spend(name, self.left)


def noisy_histogram(df: DataFrame, c: str, bounds: tuple[float, float], epsilon: float, seed: str | int, cells: int = CELLS) -> DataFrame:
    """(cell, n): counts over an even grid of ``bounds``, each with Laplace(1 / epsilon), empty ones too.

    Values beyond the bounds count in the outermost cells; missing and non-finite ones in none.
    """
    low, high = map(float, bounds)
    v = finite(c)
    cell = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((v - F.lit(low)) / F.lit((high - low) / cells)).cast("int")))
    counts = df.filter(v.isNotNull()).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    grid = df.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    noise = laplace(uniform(seed, F.lit("median"), F.lit(c), "cell"), 1.0 / epsilon)
    return grid.join(counts, "cell", "left").select("cell", (F.coalesce(F.col("c"), F.lit(0)) + noise).alias("n"))


def noisy_median(df: DataFrame, c: str, bounds: tuple[float, float], epsilon: float, seed: str | int, cells: int = CELLS) -> float:
    """Middle of the cell in which half of the noisy counts, none below 0, is reached."""
    low, high = map(float, bounds)
    # one number per public cell
    counts = [max(r["n"], 0.0) for r in noisy_histogram(df, c, bounds, epsilon, seed, cells).orderBy("cell").collect()]
    half, upto = sum(counts) / 2, 0.0
    for i, n in enumerate(counts):
        upto += n
        if upto >= half and half > 0:
            return low + (i + 0.5) * (high - low) / cells
    return (low + high) / 2


def noisy_moments(df: DataFrame, bounds: Mapping[str, tuple[float, float]], epsilon: float, seed: str | int) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; ``epsilon`` is shared evenly by all counts, sums and squares.

    Values are clipped to their bounds; a missing one counts as the middle, so that a row
    always adds one to the count.  With h the half width, one row changes the count by 1,
    the centred sum by at most h and the sum of squares by at most h * h.
    """
    share = epsilon / (3 * len(bounds))
    aggs = []
    for i, (c, (low, high)) in enumerate(bounds.items()):
        middle = (low + high) / 2
        off = F.coalesce(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), finite(c))) - F.lit(middle), F.lit(0.0))
        aggs += [F.count(F.lit(1)).alias(f"n{i}"), F.sum(off).alias(f"s{i}"), F.sum(off * off).alias(f"q{i}")]
    row, out = df.agg(*aggs).first(), {}
    for i, (c, (low, high)) in enumerate(bounds.items()):
        half = (high - low) / 2
        draw = lambda what, sens: laplace_value(uniform_value(seed, what, c), sens / share)  # noqa: B023,E731
        n = max(row[f"n{i}"] + draw("count", 1.0), 1.0)
        mean = min(max(((row[f"s{i}"] or 0.0) + draw("sum", half)) / n, -half), half)
        variance = ((row[f"q{i}"] or 0.0) + draw("square", half * half)) / n - mean * mean
        out[c] = ((low + high) / 2 + mean, max(min(variance, half * half), MIN_VARIANCE) ** 0.5)
    return out


def noisy_categories(df: DataFrame, c: str, values: Sequence[str], epsilon: float, seed: str | int) -> dict[str, float]:
    """Counts of a public list of values, each with Laplace(1 / epsilon); other values are not released."""
    counts = {r["v"]: r["n"] for r in df.filter(col(c).cast("string").isin(list(values))).groupBy(col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {v: counts.get(v, 0) + laplace_value(uniform_value(seed, "category", c, v), 1.0 / epsilon) for v in sorted(values)}


def fit_private_features(
    train: DataFrame, bounds: Mapping[str, tuple[float, float]], categories: Mapping[str, Sequence[str]], ledger: Ledger, epsilon: float,
    target: str | None = None, skip: Sequence[str] = (), seed: str | int | None = None, cells: int = CELLS,
) -> FeatureSet:
    """A preparation whose every statistic is booked in ``ledger``; together they cost ``epsilon``.

    Half goes to scales, the other half in equal parts to the medians and the category
    counts.  Columns are those of ``train``; each numeric one needs bounds, each text one
    its public values.
    """
    numeric, categorical = feature_roles(train.drop(*skip), target)
    missing = [c for c in numeric if c not in bounds] + [c for c in categorical if c not in categories]
    if missing:
        raise ValueError(f"no public bounds or values for {', '.join(missing)}")
    seed = fresh_seed() if seed is None else seed
    fs = FeatureSet(numeric, categorical)
    parts = len(numeric) + len(categorical)
    scale_share = epsilon / 2 if numeric else 0.0
    each = (epsilon - scale_share) / parts if parts else 0.0
    for c in numeric:
        fs.medians[c] = noisy_median(train, c, bounds[c], ledger.spend(f"median of {c}", each), seed, cells)
    for c in categorical:
        counts = noisy_categories(train, c, categories[c], ledger.spend(f"categories of {c}", each), seed)
        fs.categories[c], fs.widths[c] = sorted(counts), len(counts)
        fs.modes[c] = min(counts, key=lambda v: (-counts[v], v)) if counts else None
    if numeric:
        filled = train.select(*[F.coalesce(finite(c), F.lit(fs.medians[c])).alias(c) for c in numeric])
        fs.scales = noisy_moments(filled, {c: bounds[c] for c in numeric}, ledger.spend("scales", scale_share), seed)
    return fs
