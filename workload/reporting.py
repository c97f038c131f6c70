"""Reports over wide results, and whole experiments over prepared tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hushframe.operators import deep_forest, membership, models, quantized_trees
from hushframe.operators.splits import hash_split
from hushframe.plans import reports, sweeps
from workload.common import (
    ITEM, PERSON_EXTRA, PERSON_KEY, PERSON_QI, SEED, WIDE, WIDE_SQL, person, query, r, rounded, table, wide,
)
from workload.privacy import _PROBS, _SUMMARY_COLS, KS, _WIDEST

_IDS = "Dataset, Model, Task_Type"


def _unpivot_sql(metrics_: tuple[str, ...], value: str) -> str:
    """One branch per wide column; the parsed parts of its name are literals."""
    out = []
    for c, method, metric, eps, norm in reports.parse_metric_names(list(WIDE), metrics_):
        out.append(
            f"SELECT {_IDS}, '{method}' AS Method, '{metric}' AS Metric_Type, \"{c}\" AS {value}, '{eps}' AS Epsilon, '{norm}' AS Data_Norm FROM wide"
        )
    return " UNION ALL ".join(out)


_U = f"WITH {WIDE_SQL}, raw AS ({_unpivot_sql(reports.UTILITY_METRICS, 'Score')}), lng AS MATERIALIZED (SELECT * FROM raw WHERE Score IS NOT NULL)"
_C = (
    f"WITH {WIDE_SQL}, raw AS ({_unpivot_sql(reports.COST_METRICS, 'Seconds')}), "
    "lng AS MATERIALIZED (SELECT Dataset, Model, Task_Type, Method, Metric_Type AS Metric, Seconds FROM raw WHERE Seconds > 0)"
)


@query("unpivot_utility", f"{_U} SELECT {_IDS}, Method, Metric_Type, round(Score, 6) AS Score, Epsilon, Data_Norm FROM lng")
def unpivot_utility(spark, sf):
    return rounded(reports.unpivot_utility(wide(spark, sf)), ["Score"])


@query("unpivot_cost", f"{_C} SELECT {_IDS}, Method, Metric, round(Seconds, 6) AS Seconds FROM lng")
def unpivot_cost(spark, sf):
    return rounded(reports.unpivot_cost(wide(spark, sf)), ["Seconds"])


def _best_sql(metric: str, task: str) -> str:
    return (
        "(SELECT Dataset, Task_Type, Model, Method, Score, Epsilon, Data_Norm FROM (SELECT *, row_number() OVER (PARTITION BY Dataset, Task_Type, Model, Method "
        f"ORDER BY Score DESC, Epsilon, Data_Norm) AS rn FROM lng WHERE Metric_Type = '{metric}' AND Task_Type = '{task}') WHERE rn = 1)"
    )


@query(
    "best_tradeoff_cls",
    f"""{_U} SELECT f.Dataset, f.Task_Type, f.Model, f.Method, round(f.Score, 6) AS Best_F1_Score, f.Epsilon AS Epsilon_f1, f.Data_Norm AS Data_Norm_f1,
      round(a.Score, 6) AS Best_AUC_Score, a.Epsilon AS Epsilon_auc, a.Data_Norm AS Data_Norm_auc
    FROM {_best_sql('F1', 'classification')} f JOIN {_best_sql('AUC', 'classification')} a USING (Dataset, Task_Type, Model, Method)""",
)
def best_tradeoff_cls(spark, sf):
    best = reports.best_tradeoff_cls(reports.unpivot_utility(wide(spark, sf)))
    return rounded(best, ["Best_F1_Score", "Best_AUC_Score"])


@query(
    "best_tradeoff_reg",
    f"{_U} SELECT Dataset, Task_Type, Model, Method, round(Score, 6) AS Best_R2_Score, Epsilon, Data_Norm FROM {_best_sql('R2', 'regression')}",
)
def best_tradeoff_reg(spark, sf):
    return rounded(reports.best_tradeoff_reg(reports.unpivot_utility(wide(spark, sf))), ["Best_R2_Score"])


_PHASES = [*reports.COST_METRICS, "Total_Time_Sec", "Overhead_Factor"]


@query(
    "cost_report",
    f"""{_C}, p AS (SELECT Dataset, Model, Task_Type, Method, {', '.join(f"coalesce(avg(Seconds) FILTER (WHERE Metric = '{m}'), 0) AS {m}" for m in reports.COST_METRICS)}
      FROM lng GROUP BY ALL), t AS (SELECT *, TrainTime + InfTime + CompileTime AS total FROM p),
    n AS (SELECT l_returnflag AS Dataset, count(*) AS Dataset_Rows FROM lineitem GROUP BY 1)
    SELECT t.Dataset, t.Model, t.Task_Type, t.Method, {', '.join(f'round(t.{m}, 6) AS {m}' for m in reports.COST_METRICS)}, round(t.total, 6) AS Total_Time_Sec,
      round(CASE WHEN b.total > 0 THEN t.total / b.total ELSE 1 END, 6) AS Overhead_Factor, Dataset_Rows
    FROM t LEFT JOIN t b ON b.Method = 'Baseline' AND b.Dataset = t.Dataset AND b.Model = t.Model LEFT JOIN n ON n.Dataset = t.Dataset""",
)
def cost_report(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("Dataset")).agg(F.count(F.lit(1)).alias("Dataset_Rows"))
    return rounded(reports.cost_report(reports.unpivot_cost(wide(spark, sf)), sizes), _PHASES)


_EPS = ("0.1", "0.5", "1.0")


def _curve_sql() -> str:
    out = []
    for e in _EPS:
        cells = []
        for prefix, label in reports.CURVE_METHODS.items():
            c = f"{prefix}_F1_Eps{e}_Norm1.0"
            cells.append(f'round("{c}", 6) AS "{label}"' if c in WIDE else f'NULL::DOUBLE AS "{label}"')
        out.append(f"SELECT Dataset, Model, round(Baseline_F1, 6) AS Baseline, '{e}' AS Epsilon, {', '.join(cells)} FROM wide")
    return " UNION ALL ".join(out)


@query("tradeoff_curve", f"WITH {WIDE_SQL} {_curve_sql()}")
def tradeoff_curve(spark, sf):
    return rounded(reports.tradeoff_curve(wide(spark, sf), _EPS), ["Baseline", *reports.CURVE_METHODS.values()])


_EXPORT = ["Baseline_F1", "DP_F1_Eps0.5_Norm10", "DP_F1_Eps1.0_Norm1.0"]


@query(
    "pivot_export",
    f"""WITH {ITEM} SELECT l_returnflag AS Dataset, 'm' AS Model, 'classification' AS Task_Type,
      round(avg(l_discount) FILTER (WHERE l_tax < 0.025), 6) AS "Baseline_F1", round(avg(l_discount) FILTER (WHERE l_tax >= 0.025 AND l_tax < 0.055), 6) AS "DP_F1_Eps0.5_Norm10",
      round(avg(l_discount) FILTER (WHERE l_tax >= 0.055), 6) AS "DP_F1_Eps1.0_Norm1.0" FROM item GROUP BY 1""",
)
def pivot_export(spark, sf):
    t = table(spark, sf, "lineitem")
    tax = F.col("l_tax")
    part = lambda a, b, c: F.when(tax < 0.025, a).when(tax < 0.055, b).otherwise(c)
    long = (
        t.select(
            F.col("l_returnflag").alias("Dataset"), F.lit("m").alias("Model"), F.lit("classification").alias("Task_Type"),
            part(F.lit("Baseline"), F.lit("DP"), F.lit("DP")).alias("Method"), F.lit("F1").alias("Metric"),
            part(F.lit(None), F.lit(0.5), F.lit(1.0)).alias("Epsilon"), part(F.lit(None), F.lit(10.0), F.lit(1.0)).alias("Data_Norm"),
            "l_discount",
        )
        .groupBy("Dataset", "Model", "Task_Type", "Method", "Metric", "Epsilon", "Data_Norm")
        .agg(F.avg("l_discount").alias("Value"))
    )
    out = reports.pivot_export(long, _EXPORT)
    return out.select("Dataset", "Model", "Task_Type", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in _EXPORT])


_CELLS = [("DP", "0.25"), ("DP", "0.5"), ("DP", "10"), ("KAnon", "10"), ("KAnon", "50")]
_EXPORT_K = [f"DP_F1_Eps1.0_Norm{v}" if m == "DP" else f"KAnon_F1_K{v}" for m, v in _CELLS]


@query(
    "pivot_export_k",
    f"WITH {ITEM} SELECT l_returnflag AS Dataset, 'm' AS Model, 'classification' AS Task_Type, "
    + ", ".join(f'round(avg(l_discount) FILTER (WHERE CAST(l_quantity AS BIGINT) % 5 = {i}), 6) AS "{c}"' for i, c in enumerate(_EXPORT_K))
    + " FROM item GROUP BY 1",
)
def pivot_export_k(spark, sf):
    """Norms below one and every k keep a column of their own."""
    at = (F.col("l_quantity").cast("bigint") % 5).cast("int")
    private = F.when(at < 3, F.lit("DP")).otherwise(F.lit("KAnon"))
    norm, k = F.when(at == 0, 0.25).when(at == 1, 0.5).otherwise(10.0), F.when(at == 3, 10).when(at == 4, 50)
    long = (
        table(spark, sf, "lineitem").select(
            F.col("l_returnflag").alias("Dataset"), F.lit("m").alias("Model"), F.lit("classification").alias("Task_Type"),
            private.alias("Method"), F.lit("F1").alias("Metric"), F.when(at < 3, F.lit(1.0)).alias("Epsilon"),
            F.when(at < 3, norm).alias("Data_Norm"), k.alias("K"), "l_discount",
        )
        .groupBy("Dataset", "Model", "Task_Type", "Method", "Metric", "Epsilon", "Data_Norm", "K")
        .agg(F.avg("l_discount").alias("Value"))
    )
    out = reports.pivot_export(long)
    return out.select("Dataset", "Model", "Task_Type", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in _EXPORT_K])


# --- re-identification reports: the risk half has SQL, the forest half is library-specific

_REID = (
    _WIDEST + f", {_PROBS}, s AS (SELECT k, pid, count(*) AS n FROM l GROUP BY ALL), "
    "c AS (SELECT k, count(*) AS n_partitions, min(n) AS min_size, round(avg(n), 6) AS mean_size FROM s GROUP BY k), "
    "q AS (SELECT k, round(1e0 / k, 6) AS theoretical, round(avg(pb), 6) AS mean_basic, round(avg(pe), 6) AS mean_enhanced, "
    "round(avg(pb) * k, 6) AS ratio_basic, round(avg(pe) * k, 6) AS ratio_enhanced, "
    "round(avg(CASE WHEN pb >= 0.2 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pct_basic, round(avg(CASE WHEN pe >= 0.2 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pct_enhanced "
    "FROM pr GROUP BY k) SELECT * FROM c JOIN q USING (k)"
)


@query("reid_report", _REID)
def reid_report(spark, sf):
    out = sweeps.reid_report(
        person(spark, sf), PERSON_KEY, PERSON_QI, PERSON_EXTRA, "label", "classification", KS, targets=None, utility=False
    )
    return rounded(out, ["mean_size", *_SUMMARY_COLS])


@query("reid_report_utility")
def reid_report_utility(spark, sf):
    return sweeps.reid_report(
        person(spark, sf), PERSON_KEY, PERSON_QI, PERSON_EXTRA, "label", "classification", [100], seed=SEED
    )


@query("reid_report_reg")
def reid_report_reg(spark, sf):
    p = person(spark, sf)
    return sweeps.reid_report(
        p, PERSON_KEY, ["c_acctbal", "order_days"], PERSON_EXTRA, "o_totalprice", "regression", [100], seed=SEED
    )


# --- plain models


def _people(spark, sf, label: str):
    rows = person(spark, sf).withColumn("price", F.log1p("o_totalprice"))
    x = ["c_acctbal", "order_days", "c_nationkey"] if label == "price" else PERSON_QI
    ready = VectorAssembler(inputCols=x, outputCol="features").transform(rows)
    ready = hash_split(ready.select("o_orderkey", "features", F.col(label).cast("double").alias("label")), PERSON_KEY, 0.2, SEED)
    return ready.filter(~F.col("is_test")), ready.filter("is_test")


def _model_query(name: str, model: str, label: str, **options: object) -> None:
    @query(name)
    def run(spark, sf):
        train, test = _people(spark, sf, label)
        scored = models.fit(model, train, **options)(test)
        extra = [r(F.col("prob")[1]).alias("p1")] if "prob" in scored.columns else []
        return scored.select("o_orderkey", "label", r("prediction").alias("prediction"), *extra)


_model_query("lr_scores", "lr", "label")
_model_query("dt_scores", "dt", "label")
_model_query("rf_scores", "rf", "label")
_model_query("dt_reg_scores", "dt_reg", "price")
_model_query("rf_reg_scores", "rf_reg", "price")


@query("quantized_rf_scores")
def quantized_rf_scores(spark, sf):
    """Ten fitted trees of depth five on 8-bit features; the test walks the same arrays row by row."""
    train, test = _people(spark, sf, "label")
    scored = quantized_trees.scorer(quantized_trees.fit("rf", train, len(PERSON_QI)), len(PERSON_QI))(test)
    return scored.select("o_orderkey", "label", "prediction", r(F.col("prob")[1]).alias("p1"))


@query("deep_forest_scores")
def deep_forest_scores(spark, sf):
    """A hundred uncapped trees on the quasi-identifiers, as the re-identification report fits them."""
    train, test = _people(spark, sf, "label")
    scored = deep_forest.score_forest(test, deep_forest.fit_forest(train, len(PERSON_QI), PERSON_KEY, seed=SEED))
    return scored.select("o_orderkey", "label", "prediction", r(F.col("prob")[1]).alias("p1"))


def _ready(spark, sf, task: str = "classification"):
    p = person(spark, sf)
    if task == "classification":
        rows, target, bounds = p.drop("o_orderpriority"), "label", None
    else:
        rows = p.select("o_orderkey", "c_acctbal", "order_days", "c_mktsegment", F.log1p("o_totalprice").alias("price"))
        target, bounds = "price", (0.0, 14.0)
    return sweeps.prepare(rows, "orders", PERSON_KEY, target, task, bounds, seed=SEED)


@query("baseline_eval")
def baseline_eval(spark, sf):
    return sweeps.privacy_sweep(_ready(spark, sf), methods=(sweeps.BASELINE,), seed=SEED)


@query("dp_eval")
def dp_eval(spark, sf):
    return sweeps.privacy_sweep(_ready(spark, sf), (1.0,), (10.0,), ("lr", "nb", "dt", "rf"), (sweeps.DP,), seed=SEED, timings=False)


@query("privacy_sweep")
def privacy_sweep(spark, sf):
    p = _ready(spark, sf, "regression")
    return sweeps.privacy_sweep(p, (0.5, 5.0), (1.0,), ("lr",), seed=SEED, timings=False)


@query("sweep_report")
def sweep_report(spark, sf):
    """A sweep's own rows, wide and back, to the best score per technique."""
    long = sweeps.privacy_sweep(_ready(spark, sf, "regression"), (0.5, 5.0), (1.0, 2.5), ("lr",), seed=SEED, timings=False)
    return reports.best_tradeoff_reg(reports.unpivot_utility(reports.pivot_export(long.filter("Metric = 'R2'"))))


@query("kanon_utility")
def kanon_utility(spark, sf):
    p = hash_split(person(spark, sf).drop("o_orderpriority", "c_nationkey"), PERSON_KEY, 0.2, SEED)
    train, test = (p.filter(c).drop("is_test") for c in (~F.col("is_test"), F.col("is_test")))
    return sweeps.kanon_utility(train, test, "orders", PERSON_KEY, "label", "classification", (10, 100), ("lr", "nb"), seed=SEED, timings=False)


@query("mia_infer")
def mia_infer(spark, sf):
    train, test = _people(spark, sf, "label")
    scorer = models.fit("dt", train)
    attack = membership.attack_split(membership.attack_table(scorer, train, test, PERSON_KEY), PERSON_KEY, SEED)
    inferred = membership.forest_attack(attack, [0, 1])
    return inferred.select("o_orderkey", "label", "member", "inferred")


@query("mia_sweep")
def mia_sweep(spark, sf):
    return sweeps.mia_sweep(_ready(spark, sf), (1.0,), (1.0,), ("lr", "nb"), seed=SEED)


