"""Secrets in texts, with weak candidates linked to the parts that complete them.

A credential has parts: an identifier, a secret, an endpoint.  The base patterns are
strong and always reported.  Weak candidates (a bare 40-character key, a short assigned
value, a user name, a URL) are reported only where their complement lies in the same
text with at most ``SCOPE`` characters between the two: a weak secret or user name needs
the other of identifier and secret, an endpoint needs both.

Linking is an interval join that never makes pairs.  An interval is near a candidate if
it starts no later than SCOPE after the candidate's end and ends no earlier than SCOPE
before its start.  So a candidate needs one number per role: the furthest end among the
intervals that start in time, a running maximum over the text's parts in order.

Defined cases: a null text is empty; repeated rows are searched each on its own;
positions count code points; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import text_of, with_row_id
from hushframe.session import stage

SCOPE = 200
# Fixed by the contract: the base patterns, in the order of their kinds.  Runs shorter
# than asked for cannot hide a longer one, so access and hex ask for the length at once.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
# Weak candidates; "short" ones are assignments whose value is too short for the base.
SHORT_LENGTH = 4
WEAK = {
    "key": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])",
    "user": r"""(?i)(?<![A-Za-z0-9])(user|user_?name|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""",
    "endpoint": r"""(?<![A-Za-z0-9_])[a-z][a-z0-9+.]{1,12}://[^\s"'<>]+""",
}
KINDS = [*BASE, "short", *WEAK]
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "short", "key", "hex")


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Matches of one kind in order: characters before each since the last, its own, its value's.

    The parts between matches and the matches themselves are cut by the same pattern,
    so their lengths add up to the positions.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits
    lengths = lambda a: F.transform(a, F.length)
    zipped = F.arrays_zip(lengths(hits).alias("a"), lengths(gaps).alias("b"), lengths(value).alias("c"))
    rows = F.transform(
        zipped,
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["a"].alias("length"), z["b"].alias("gap"), z["c"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:string,i:int,length:int,gap:int,value:int>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.slice(rows, F.lit(1), F.size(hits))).otherwise(none)


def parts(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, parts): staged (row, doc_id, found) and per part row, kind, start, end."""
    text = F.col("text")
    docs = with_row_id(scan.select("doc_id", text_of().alias("text")), "row")
    found = F.concat(*[_found(text, k, p) for k, p in {**BASE, **WEAK}.items()])
    docs = stage(docs.select("row", "doc_id", found.alias("found")))
    rows = docs.select("row", F.explode("found").alias("f")).select("row", "f.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    short = (F.col("kind") == "assign") & (F.col("value") < ASSIGN_LENGTH)
    rows = rows.filter(~short | (F.col("value") >= SHORT_LENGTH)).withColumn("kind", F.when(short, F.lit("short")).otherwise(F.col("kind")))
    return docs, rows.select("row", "kind", "start", "end")


def linked(found: DataFrame) -> DataFrame:
    """Strong parts and the weak ones whose complement is near: row, kind, start, end."""
    found = stage(found)
    weak = ~F.col("kind").isin(*BASE)
    role = lambda kinds: F.when(F.col("kind").isin(*kinds), F.col("end"))
    # every part is met at its start; a weak one asks at the last place where a near part may start
    met = found.select("row", F.col("start").alias("at"), F.lit(0).alias("asks"), "kind", "start", "end", role(IDENTIFIERS).alias("id"), role(SECRETS).alias("secret"))
    none = F.lit(None).cast(found.schema["end"].dataType)
    asked = found.filter(weak).select("row", (F.col("end") + SCOPE).alias("at"), F.lit(1).alias("asks"), "kind", "start", "end", none.alias("id"), none.alias("secret"))
    sofar = Window.partitionBy("row").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    swept = met.unionByName(asked).withColumns({c: F.max(c).over(sofar) for c in ("id", "secret")}).filter("asks = 1")
    near = lambda c: F.coalesce(F.col(c) >= F.col("start") - SCOPE, F.lit(False))
    needs = (
        F.when(F.col("kind") == "user", near("secret")).when(F.col("kind") == "endpoint", near("id") & near("secret")).otherwise(near("id"))
    )
    return found.filter(~weak).unionByName(swept.filter(needs).select("row", "kind", "start", "end"))


def document_secrets(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    docs, found = parts(documents)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.concat_ws(":", "kind", "start", "end")
    base = F.col("kind").isin(*BASE)
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: s["span"]), ",")
    one = F.struct(F.col("start"), order.alias("o"), F.col("end"), span.alias("span"))
    spans = linked(found).groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        joined(F.collect_list(F.when(base, one))).alias("base_spans"), joined(F.collect_list(one)).alias("spans"),
    )
    zero, empty = F.lit(0).cast("long"), F.lit("")
    return docs.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base_spans", empty).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", empty).alias("spans"),
    )
