"""Sources, cleaning, splits and feature preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions import scalars
from hushframe.functions.noise import uniform
from hushframe.operators import aggregates, clean, features, joins, splits
from hushframe.operators.smote import smote
from hushframe.session import ensure_checkpoint_dir
from hushframe.sources import registry, results
from workload.common import (
    DIRTY, DOCS, ITEM, ITEM_KEY, ITEM_KEYS, ITEM_X, PERSON, SEED, WIDE_SQL, dirty, docs, item, person, query, r, rounded, table,
    u_sql, wide,
)

# --- sources and sinks


@query(
    "scan_project",
    "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 25",
)
def scan_project(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.filter(F.col("l_quantity") >= 25).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


# order lines as text: a quantity and a date that do not parse wherever discount or tax say so
_CSV = registry.DatasetSpec(
    "lines", "", T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_quantity", T.DoubleType()), T.StructField("l_tax", T.DoubleType())]),
    lambda df: df, "l_quantity", null_value="?",
)
_CSV_QUANTITY = "CASE WHEN l_discount = 0.05 THEN 'about ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) WHEN l_discount = 0.07 THEN '?' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END"


def _as_csv(spark, sf):
    """The order lines as CSV files in the shared folder, parsed again with a schema."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}.csv"
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey", f"{_CSV_QUANTITY} AS l_quantity", "CASE WHEN l_tax = 0.03 THEN '3%' ELSE CAST(l_tax AS STRING) END AS l_tax")
    lines.write.option("header", True).csv(path)
    return registry.read_checked(spark, _CSV, path)


@query(
    "scan_csv",
    "SELECT l_orderkey, l_partkey, CASE WHEN l_discount IN (0.05, 0.07) THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_tax = 0.03 THEN NULL ELSE l_tax END AS l_tax FROM lineitem",
)
def scan_csv(spark, sf):
    return _as_csv(spark, sf)[0]


@query(
    "csv_rejects",
    """SELECT 'l_quantity' AS name, 'about ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS text, count(*) AS n FROM lineitem WHERE l_discount = 0.05 GROUP BY ALL
    UNION ALL SELECT 'l_tax', '3%', count(*) FROM lineitem WHERE l_tax = 0.03 GROUP BY ALL""",
)
def csv_rejects(spark, sf):
    return _as_csv(spark, sf)[1].groupBy(F.col("column").alias("name"), "text").agg(F.count("*").alias("n"))


@query(
    "results_union",
    f"""WITH {ITEM}
    SELECT l_returnflag AS Dataset, 'Baseline' AS Type, round(avg(l_discount), 6) AS Baseline_F1, NULL::DOUBLE AS DP_F1 FROM item GROUP BY 1
    UNION ALL SELECT l_returnflag, 'DP', NULL, round(avg(l_tax), 6) FROM item GROUP BY 1""",
)
def results_union(spark, sf):
    g = item(spark, sf).groupBy(F.col("l_returnflag").alias("Dataset"))
    base = g.agg(r(F.avg("l_discount")).alias("Baseline_F1")).withColumn("Type", F.lit("Baseline"))
    dp = g.agg(r(F.avg("l_tax")).alias("DP_F1")).withColumn("Type", F.lit("DP"))
    return results.results_union(base, dp)


@query("project_present", f'WITH {WIDE_SQL} SELECT Dataset, Model, Task_Type, round(Time_DP, 6) AS Time_DP FROM wide')
def project_present(spark, sf):
    return rounded(results.project_present(wide(spark, sf)), ["Time_DP"])


_GRID_SQL = """ds AS (SELECT DISTINCT l_returnflag AS Dataset,
         CASE WHEN l_returnflag = 'N' THEN 'regression' ELSE 'classification' END AS Task_Type FROM lineitem),
  m AS (SELECT Dataset, Task_Type, CASE WHEN Task_Type = 'regression' THEN reg ELSE cls END AS Model
        FROM ds, (VALUES ('lr', 'lin_reg'), ('nb', NULL), ('dt', 'dt_reg'), ('rf', 'rf_reg')) v(cls, reg)),
  grid AS (SELECT Dataset, Task_Type, Model, 'Baseline' AS Type, NULL::DOUBLE AS Epsilon, NULL::DOUBLE AS Data_Norm
           FROM m WHERE Model IS NOT NULL
           UNION ALL
           SELECT Dataset, Task_Type, Model, 'DP', e, n
           FROM m, (VALUES (0.1e0), (0.5e0), (1e0), (5e0), (10e0)) a(e), (VALUES (1e0), (10e0), (100e0)) b(n)
           WHERE Model IS NOT NULL AND (Task_Type <> 'regression' OR Model = 'lin_reg'))"""


def _datasets(spark, sf):
    task = F.when(F.col("l_returnflag") == "N", "regression").otherwise("classification")
    return item(spark, sf).select(F.col("l_returnflag").alias("Dataset"), task.alias("Task_Type")).distinct()


@query("param_grid", f"WITH {_GRID_SQL} SELECT * FROM grid")
def param_grid(spark, sf):
    return aggregates.param_grid(_datasets(spark, sf))


@query(
    "pending_grid",
    f"""WITH {_GRID_SQL}, done AS (SELECT DISTINCT l_returnflag AS Dataset, 'lr' AS Model,
           CASE WHEN l_linestatus = 'O' THEN 'Baseline' ELSE 'DP' END AS Type,
           CASE WHEN l_linestatus = 'O' THEN NULL ELSE 0.5e0 END AS Epsilon,
           CASE WHEN l_linestatus = 'O' THEN NULL ELSE 10e0 END AS Data_Norm FROM lineitem)
    SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.Dataset = g.Dataset AND d.Model = g.Model
      AND d.Type = g.Type AND d.Epsilon IS NOT DISTINCT FROM g.Epsilon AND d.Data_Norm IS NOT DISTINCT FROM g.Data_Norm)""",
)
def pending_grid(spark, sf):
    plain = F.col("l_linestatus") == "O"
    none = F.lit(None).cast("double")
    done = item(spark, sf).select(
        F.col("l_returnflag").alias("Dataset"), F.lit("lr").alias("Model"),
        F.when(plain, "Baseline").otherwise("DP").alias("Type"),
        F.when(plain, none).otherwise(0.5).alias("Epsilon"), F.when(plain, none).otherwise(10.0).alias("Data_Norm"),
    )
    return joins.pending_grid(aggregates.param_grid(_datasets(spark, sf)), done, ["Dataset", "Model", "Type", "Epsilon", "Data_Norm"])


# --- cleaning

_D = f"WITH {DIRTY} "


@query(
    "clean_null_tokens",
    _D + f"""SELECT {ITEM_KEYS}, CASE WHEN trim(flag) = '?' THEN NULL ELSE flag END AS flag, status,
           CASE WHEN trim(qty) = '?' THEN NULL ELSE qty END AS qty, sparse, filled, price FROM dirty""",
)
def clean_null_tokens(spark, sf):
    return clean.null_tokens(dirty(spark, sf))


@query("drop_cols", _D + f"SELECT {ITEM_KEYS}, flag, status, qty, filled, price FROM dirty")
def drop_cols(spark, sf):
    return clean.drop_columns(dirty(spark, sf), ["sparse", "not_there"])


@query("dedup_rows", _D + "SELECT DISTINCT flag, status, qty, filled FROM dirty")
def dedup_rows(spark, sf):
    return clean.dedup(clean.drop_columns(dirty(spark, sf), [*ITEM_KEY, "sparse", "price"]))


@query(
    "sparse_columns",
    _D + "SELECT c AS \"column\", v AS non_null, n AS n_rows, v >= n * 0.5 AS kept FROM ("
    "SELECT count(*) AS n, count(flag) AS flag, count(status) AS status, count(sparse) AS sparse, count(filled) AS filled, "
    "count(price) AS price FROM dirty) UNPIVOT (v FOR c IN (flag, status, sparse, filled, price))",
)
def sparse_columns(spark, sf):
    return clean.sparse_columns(dirty(spark, sf).select("flag", "status", "sparse", "filled", "price"))


@query("drop_sparse", _D + f"SELECT {ITEM_KEYS}, flag, status, qty, filled, price FROM dirty")
def drop_sparse(spark, sf):
    return clean.drop_sparse_columns(dirty(spark, sf))


@query(
    "coerce_numeric",
    _D + f"SELECT {ITEM_KEYS}, flag, CAST(CASE WHEN qty = '?' THEN NULL ELSE qty END AS DOUBLE) AS qty FROM dirty",
)
def coerce_numeric(spark, sf):
    d = dirty(spark, sf).select(*ITEM_KEY, "flag", F.when(F.col("qty") != "?", F.col("qty")).alias("qty"))
    return clean.coerce_numeric(d)


@query("label_contains", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 1 ELSE 0 END AS label FROM orders")
def label_contains(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.label_contains("o_orderpriority", "HIGH").alias("label"))


@query("label_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM orders")
def label_map(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.label_map("o_orderstatus", {"F": 1, "O": 0}).alias("label"))


@query(
    "range_filter",
    """WITH e AS (SELECT event_id, user_id, value, event_type,
           CASE WHEN event_type = 'view' THEN NULL ELSE value - 40 END AS days,
           CASE WHEN event_type = 'signup' THEN NULL WHEN value > 60 THEN -1 ELSE 1 END AS recid,
           CASE WHEN event_type = 'error' THEN 'O' WHEN event_type = 'click' THEN NULL ELSE 'F' END AS degree FROM events)
    SELECT event_id, user_id, value FROM e
    WHERE days >= -30 AND days <= 30 AND recid IS DISTINCT FROM -1 AND degree IS DISTINCT FROM 'O'""",
)
def range_filter(spark, sf):
    kind = F.col("event_type")
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "value",
        F.when(kind != "view", F.col("value") - 40).alias("days"),
        F.when(kind == "signup", F.lit(None)).when(F.col("value") > 60, -1).otherwise(1).alias("recid"),
        F.when(kind == "error", "O").when(kind == "click", F.lit(None)).otherwise("F").alias("degree"),
    )
    return clean.arrest_window(e, "days", "recid", "degree", ["event_id", "user_id", "value"])


@query("log1p_target", f"WITH {ITEM} SELECT {ITEM_KEYS}, round(ln(1 + l_extendedprice), 6) AS target FROM item")
def log1p_target(spark, sf):
    return item(spark, sf).select(*ITEM_KEY, r(scalars.log1p_target("l_extendedprice")).alias("target"))


@query("drop_null_target", _D + f"SELECT {ITEM_KEYS}, price FROM dirty WHERE price IS NOT NULL")
def drop_null_target(spark, sf):
    return clean.drop_null_target(dirty(spark, sf).select(*ITEM_KEY, "price"), "price")


@query("rename_last", "SELECT event_id, event_type, value AS target FROM events")
def rename_last(spark, sf):
    return clean.rename_last(table(spark, sf, "events").select("event_id", "event_type", "value"), "target")


@query(
    "trim_drop_null",
    _D + f"SELECT {ITEM_KEYS}, trim(flag) AS flag, trim(status) AS status, qty, price FROM dirty WHERE status IS NOT NULL AND price IS NOT NULL",
)
def trim_drop_null(spark, sf):
    d = dirty(spark, sf).select(*ITEM_KEY, F.col("flag").alias(" flag "), "status", F.col("qty").alias("qty "), "price")
    return clean.drop_any_null(clean.trim_all(d))


@query("label_encode", "SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents")
def label_encode(spark, sf):
    return features.label_encode(table(spark, sf, "documents").select("doc_id", "source"), "source", "code")


@query("clip_bounds", "SELECT event_id, greatest(-50e0, least(50e0, value - 60)) AS clipped FROM events")
def clip_bounds(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.clip(F.col("value") - 60, -50, 50).alias("clipped"))


@query(
    "sigmoid_label",
    "SELECT event_id, round(1 / (1 + exp(-(value - 40) / 10)), 6) AS p, CASE WHEN 1 / (1 + exp(-(value - 40) / 10)) > 0.5 THEN 1 ELSE 0 END AS label FROM events",
)
def sigmoid_label(spark, sf):
    s = (F.col("value") - 40) / 10
    return table(spark, sf, "events").select("event_id", r(scalars.sigmoid(s)).alias("p"), scalars.sigmoid_label(s).alias("label"))


@query("observed_bounds", "SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def observed_bounds(spark, sf):
    return aggregates.observed_bounds(table(spark, sf, "lineitem"), "l_extendedprice")


@query("classes", "SELECT DISTINCT label FROM embeddings ORDER BY label")
def classes(spark, sf):
    return aggregates.classes(table(spark, sf, "embeddings"), "label")


# --- splits and samples

_UI = u_sql(SEED, *ITEM_KEY)


@query("hash_split", f"WITH {ITEM} SELECT {ITEM_KEYS}, {_UI} < 0.3 AS is_test FROM item")
def hash_split(spark, sf):
    return splits.hash_split(item(spark, sf).select(*ITEM_KEY), ITEM_KEY, 0.3, SEED)


@query(
    "stratified_split",
    f"""WITH {ITEM}, u AS (SELECT {ITEM_KEYS}, label, {_UI} AS u FROM item),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, {ITEM_KEYS}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM u)
    SELECT {ITEM_KEYS}, label, rn <= round(0.2e0 * n) AS is_test FROM k""",
)
def stratified_split(spark, sf):
    return splits.stratified_split(item(spark, sf).select(*ITEM_KEY, "label"), ITEM_KEY, "label", 0.2, SEED)


_UE = u_sql(SEED, "event_id")


@query(
    "attack_split",
    f"SELECT event_id, event_type = 'purchase' AS member, {u_sql(SEED, 'event_type = ' + chr(39) + 'purchase' + chr(39), 'event_id')} < 0.5 AS is_eval FROM events",
)
def attack_split(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_type") == "purchase").alias("member"))
    return splits.hash_split(e, ["member", "event_id"], 0.5, SEED, "is_eval")


@query("sample_n", f"SELECT event_id, user_id, value FROM events ORDER BY {_UE}, event_id LIMIT 300")
def sample_n(spark, sf):
    return splits.sample_n(table(spark, sf, "events").select("event_id", "user_id", "value"), ["event_id"], 300, SEED)


@query(
    "balanced_sample",
    f"""WITH e AS (SELECT event_id, event_type, {_UE} AS u FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY u, event_id) AS rn FROM e),
    s AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM e GROUP BY event_type))
    SELECT event_id, event_type FROM k, s WHERE rn <= s.n""",
)
def balanced_sample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return splits.balanced_sample(e, "event_type", ["event_id"], SEED)


@query("head_n", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def head_n(spark, sf):
    return splits.head_n(table(spark, sf, "events").select("event_id", "value"), 100, ["event_id"])


@query("slice_features", f"WITH {ITEM} SELECT {ITEM_KEYS}, l_quantity, l_extendedprice FROM item")
def slice_features(spark, sf):
    return splits.slice_features(item(spark, sf), ITEM_X, 2, ITEM_KEY)


# --- features


@query(
    "impute_median",
    _D + f"SELECT {ITEM_KEYS}, round(coalesce(price, (SELECT median(price) FROM dirty)), 6) AS price, coalesce(filled, (SELECT median(filled) FROM dirty)) AS filled FROM dirty",
)
def impute_median(spark, sf):
    d = features.impute_median(dirty(spark, sf).select(*ITEM_KEY, "price", "filled"), ["price", "filled"])
    return rounded(d, ["price"])


@query(
    "standardize",
    f"""WITH {ITEM}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ITEM_X)} FROM item)
    SELECT {ITEM_KEYS}, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in ITEM_X)} FROM item, s""",
)
def standardize(spark, sf):
    return rounded(features.standardize(item(spark, sf).select(*ITEM_KEY, *ITEM_X), ITEM_X), ITEM_X)


_MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute_mode",
    _D + f""", t AS (SELECT {ITEM_KEYS}, CASE WHEN trim(flag) = '?' THEN NULL ELSE flag END AS flag, status FROM dirty)
    SELECT {ITEM_KEYS}, coalesce(flag, {_MODE.format(c='flag', t='t')}) AS flag, coalesce(status, {_MODE.format(c='status', t='t')}) AS status FROM t""",
)
def impute_mode(spark, sf):
    d = clean.null_tokens(dirty(spark, sf)).select(*ITEM_KEY, "flag", "status")
    return features.impute_mode(d, ["flag", "status"])


_LANGS = ("de", "en", "es", "fr")


@query("one_hot", "SELECT doc_id, " + ", ".join(f"CASE WHEN lang = '{v}' THEN 1 ELSE 0 END AS lang_{v}" for v in _LANGS) + " FROM documents")
def one_hot(spark, sf):
    return features.one_hot(table(spark, sf, "documents").select("doc_id", "lang"), "lang").drop("lang")


_PREP_TEXT = ("c_mktsegment",)
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_UP = u_sql(SEED, "o_orderkey")


@query(
    "prepare_features",
    f"""WITH {PERSON}, t AS (SELECT *, {_UP} < 0.2 AS is_test,
           CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM person),
    m AS (SELECT median(bal) AS mb FROM t WHERE NOT is_test),
    f AS (SELECT t.*, coalesce(bal, mb) AS b FROM t, m),
    s AS (SELECT avg(b) AS ab, stddev_pop(b) AS sb, avg(o_totalprice) AS ap, stddev_pop(o_totalprice) AS sp FROM f WHERE NOT is_test)
    SELECT o_orderkey, is_test, round((o_totalprice - ap) / sp, 6) AS f0, round((b - ab) / sb, 6) AS f1,
           {', '.join(f"CASE WHEN c_mktsegment = '{v}' THEN 1e0 ELSE 0e0 END AS f{i + 2}" for i, v in enumerate(_SEGMENTS))}
    FROM f, s""",
)
def prepare_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    bal = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal")
    p = person(spark, sf).select("o_orderkey", "o_totalprice", bal, "c_mktsegment")
    p = splits.hash_split(p, ["o_orderkey"], 0.2, SEED)
    fs = features.fit_features(p.filter(~F.col("is_test")), skip=["o_orderkey", "is_test"])
    out = fs.apply(p).select("o_orderkey", "is_test", vector_to_array("features").alias("v"))
    return out.select("o_orderkey", "is_test", *[r(F.col("v")[i]).alias(f"f{i}") for i in range(2 + len(_SEGMENTS))])


@query(
    "class_weights",
    f"""WITH {ITEM} SELECT l_returnflag, count(*) AS n,
      round((SELECT count(*) FROM item) / ((SELECT count(DISTINCT l_returnflag) FROM item) * 1e0 * count(*)), 6) AS weight
    FROM item GROUP BY l_returnflag""",
)
def class_weights(spark, sf):
    return rounded(features.class_weights(item(spark, sf), "l_returnflag"), ["weight"])


_KEYS2 = "CAST(key AS VARCHAR)"


@query(
    "smote",
    f"""WITH {DOCS}, z AS (SELECT doc_id AS key, n_chars / 1000e0 AS a, quality * 1e0 AS b FROM docs WHERE toxic = 1),
    p AS (SELECT key, a, b, min(key) OVER (PARTITION BY a, b) AS id FROM z),
    s AS (SELECT sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS m, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS big FROM docs),
    q AS (SELECT key, a, b, id, CAST((big - m) // m AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY {u_sql(SEED, "'extra'", 'key')}, key) <= (big - m) % m THEN 1 ELSE 0 END AS todo,
            least(5, m - 1) AS k FROM p, s),
    c AS (SELECT key, a, b, k, CAST(unnest(range(todo)) AS BIGINT) AS copy FROM q),
    d AS (SELECT c.*, floor({u_sql(SEED, "'neighbour'", 'key', 'copy')} * k) AS pick, {u_sql(SEED, "'gap'", 'key', 'copy')} AS gap FROM c),
    nn AS (SELECT x.key, y.a AS ya, y.b AS yb,
             row_number() OVER (PARTITION BY x.key ORDER BY (x.a - y.a) ** 2 + (x.b - y.b) ** 2, y.id, y.key) - 1 AS rk
           FROM p x JOIN p y ON x.key <> y.key)
    SELECT d.key AS doc_id, d.copy, round(d.a + gap * (ya - d.a), 6) AS a, round(d.b + gap * (yb - d.b), 6) AS b, 1 AS toxic
    FROM d JOIN nn ON nn.key = d.key AND nn.rk = d.pick""",
)
def smote_query(spark, sf):
    d = docs(spark, sf).select("doc_id", (F.col("n_chars") / 1000.0).alias("a"), F.col("quality").cast("double").alias("b"), "toxic")
    return rounded(smote(d, ["a", "b"], "toxic", "doc_id", seed=SEED), ["a", "b"])


# --- unions and picks


@query(
    "tag_union",
    f"WITH {ITEM} SELECT {ITEM_KEYS}, CASE WHEN {_UI} < 0.3 THEN 'test' ELSE 'train' END AS split FROM item",
)
def tag_union(spark, sf):
    u = uniform(SEED, *ITEM_KEY) < 0.3
    rows = item(spark, sf).select(*ITEM_KEY)
    return aggregates.tag_union(rows.filter(~u), rows.filter(u))


@query(
    "argmax_by",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
)
def argmax_by(spark, sf):
    t = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return aggregates.argmax_by(t, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query(
    "pivot_mean",
    """SELECT user_id, """ + ", ".join(
        f"round(coalesce(avg(CASE WHEN event_type = '{t}' THEN value END), 0), 6) AS {t}" for t in ("click", "view", "purchase")
    ) + " FROM events GROUP BY user_id",
)
def pivot_mean(spark, sf):
    names = ["click", "view", "purchase"]
    return rounded(aggregates.pivot_mean(table(spark, sf, "events"), ["user_id"], "event_type", "value", names), names)
