"""Registry, shared fixtures and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = 42


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: str | Column, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def rounded(df: DataFrame, cols: Sequence[str], places: int = 6) -> DataFrame:
    return df.select(*[r(c, places).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def u_sql(seed: object, *keys: str) -> str:
    """The hashed uniform draw as SQL; keys are SQL expressions."""
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"((CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def laplace_sql(u: str, scale: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5e0) * ln(1e0 - 2e0 * abs({u} - 0.5e0)))"


def num(v: float) -> str:
    """A double literal that reads back to the same value."""
    return f"CAST('{v!r}' AS DOUBLE)"


# --- fixtures: people (orders with their customer), items (order lines), documents, wide results


def person(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey", "o_totalprice", "c_acctbal", days.alias("order_days"), "c_mktsegment", "o_orderpriority",
            "c_nationkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        )
    )


PERSON = """person AS MATERIALIZED (
  SELECT o_orderkey, o_totalprice, c_acctbal,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS order_days,
         c_mktsegment, o_orderpriority, c_nationkey,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
PERSON_QI = ["o_totalprice", "c_acctbal", "order_days"]
PERSON_EXTRA = ["c_mktsegment", "o_orderpriority", "c_nationkey"]
PERSON_KEY = ["o_orderkey"]

ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
ITEM_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def item(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        *ITEM_X, "l_returnflag", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


ITEM = """item AS MATERIALIZED (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)"""
ITEM_KEYS = ", ".join(ITEM_KEY)


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with planted missing tokens, blanks, text numbers and a sparse column."""
    i = item(spark, sf)
    return i.select(
        *ITEM_KEY,
        F.when(F.col("l_discount") == 0.05, "?").when(F.col("l_discount") == 0.07, " ? ").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_tax") == 0.03, F.lit(None)).otherwise(F.concat(F.lit("  "), "l_linestatus", F.lit(" "))).alias("status"),
        F.when(F.col("l_tax") == 0.05, "?").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("qty"),
        F.when(F.col("l_quantity") > 40, F.col("l_extendedprice")).alias("sparse"),
        F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("filled"),
        F.when(F.col("l_discount") != 0.02, F.col("l_extendedprice")).alias("price"),
    )


DIRTY = ITEM + """, dirty AS MATERIALIZED (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents,
         CASE WHEN l_discount = 0.05e0 THEN '?' WHEN l_discount = 0.07e0 THEN ' ? ' ELSE l_returnflag END AS flag,
         CASE WHEN l_tax = 0.03e0 THEN NULL ELSE '  ' || l_linestatus || ' ' END AS status,
         CASE WHEN l_tax = 0.05e0 THEN '?' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
         CASE WHEN l_quantity > 40 THEN l_extendedprice END AS sparse,
         CASE WHEN l_quantity > 10 THEN l_tax END AS filled,
         CASE WHEN l_discount <> 0.02e0 THEN l_extendedprice END AS price
  FROM item)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id")


DOCS = """docs AS MATERIALIZED (
  SELECT doc_id, lang, source, n_chars, quality, toxic
  FROM documents JOIN labels USING (doc_id))"""

# Wide result rows: column name -> aggregate over the lines of one (flag, status) group.
WIDE = {
    "Baseline_F1": "avg(l_discount) * 12",
    "Baseline_AUC": "avg(l_discount) * 14",
    "Baseline_R2": "avg(l_tax) * 20",
    "DP_F1_Eps0.1_Norm1.0": "avg(l_tax) * 9",
    "DP_F1_Eps0.5_Norm1.0": "avg(l_tax * l_discount) * 180",
    "DP_F1_Eps1.0_Norm1.0": "avg(l_tax) * 11",
    "DP_F1_Eps1.0_Norm10": "avg(l_quantity) / 60",
    "DP_AUC_Eps0.1_Norm1.0": "avg(l_quantity) / 55",
    "DP_AUC_Eps1.0_Norm10": "avg(l_discount) * 11",
    "DP_R2_Eps0.1_Norm1.0": "avg(l_quantity) / 50",
    "DP_R2_Eps1.0_Norm10": "avg(l_discount) * 10",
    "DP_PHE_F1_Eps0.1_Norm1.0": "avg(l_discount) * 8",
    "DP_PHE_F1_Eps1.0_Norm1.0": "avg(l_discount * l_quantity) / 3",
    "DP_PHE_AUC_Eps1.0_Norm1.0": "avg(l_tax) * 14",
    "DP_PHE_R2_Eps1.0_Norm1.0": "avg(l_tax) * 16",
    "FHE_F1_Eps0.1_Norm1.0": "avg(l_quantity) / 45",
    "FHE_F1_Eps1.0_Norm1.0": "avg(CASE WHEN l_quantity < 0 THEN l_quantity END)",
    "FHE_AUC_Eps0.1_Norm1.0": "avg(l_quantity) / 44",
    "FHE_R2_Eps0.1_Norm1.0": "avg(l_quantity) / 43",
    "FHE_DP_F1_Eps0.1_Norm1.0": "avg(l_quantity) / 90",
    "FHE_DP_AUC_Eps0.1_Norm1.0": "avg(l_quantity) / 80",
    "Baseline_TrainTime": "avg(l_extendedprice) / 50000",
    "Baseline_InfTime": "avg(l_quantity) / 500",
    "DP_TrainTime_Eps0.1_Norm1.0": "avg(l_extendedprice) / 20000",
    "DP_TrainTime_Eps1.0_Norm10": "avg(l_extendedprice) / 25000",
    "DP_InfTime_Eps0.1_Norm1.0": "avg(l_quantity) / 400",
    "DP_PHE_TrainTime_Eps0.1_Norm1.0": "avg(l_extendedprice) / 15000",
    "DP_PHE_InfTime_Eps0.1_Norm1.0": "min(l_discount) - 1",
    "FHE_TrainTime_Eps0.1_Norm1.0": "avg(l_extendedprice) / 12000",
    "FHE_CompileTime_Eps0.1_Norm1.0": "avg(l_quantity) / 7",
    "FHE_InfTime_Eps0.1_Norm1.0": "avg(l_quantity) / 3",
    "FHE_DP_TrainTime_Eps0.1_Norm1.0": "avg(l_extendedprice) / 11000",
    "FHE_DP_CompileTime_Eps0.1_Norm1.0": "avg(l_quantity) / 6",
    "Time_DP": "avg(l_quantity) / 2",
}
_TASK = "CASE WHEN l_returnflag = 'N' THEN 'regression' ELSE 'classification' END"


def wide(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("Task_Type", F.expr(_TASK))
    return lines.groupBy(F.col("l_returnflag").alias("Dataset"), F.col("l_linestatus").alias("Model"), "Task_Type").agg(
        *[F.expr(e).alias(c) for c, e in WIDE.items()]
    )


WIDE_SQL = (
    f"wide AS MATERIALIZED (SELECT l_returnflag AS Dataset, l_linestatus AS Model, {_TASK} AS Task_Type, "
    + ", ".join(f'{e} AS "{c}"' for c, e in WIDE.items())
    + " FROM lineitem GROUP BY ALL)"
)
