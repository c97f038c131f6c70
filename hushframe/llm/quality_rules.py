"""Quality rules with thresholds learned per language and source.

Each document is measured once.  The measures of the documents that pass the base rule
go into mergeable quantile sketches: counts per value cut to its eight leading binary
digits (relative error below 1/128), one sketch per language, source and measure.
Sketches merge by adding counts, so a group with few documents uses its language's
merged sketch, and a language with few the corpus's.  A document fails where a measure
lies beyond the group's quartiles by more than three times their distance, which holds
while less than a quarter of the group is bad.  Where quartiles nearly coincide, a small
spread per measure stands for their distance: what no document of a source does at all,
one may do a little.  No fixed cutoff takes part.

Defined cases: a null text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows are judged alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import SPACES, WORD, text_of
from hushframe.operators.joins import attach
from hushframe.session import cut_lineage, stage

UNIT = 1_000_000
# measure -> (numerator, denominator, least distance of the quartiles), in millionths
MEASURES = {
    "symbols": ("n_symbols", "n_words", 10_000),
    "dup_lines": ("n_dup_lines", "n_lines", 100_000),
    "repeats": ("n_repeat_words", "n_words", 100_000),
    "word_length": ("word_chars", "n_words", 250_000),
}
DIGITS = 8
FENCE = 3
MIN_DOCS = 200


def repeated_words(words: str) -> Column:
    """Words covered by 3-word windows that occur at least twice; ``words`` names an array column."""
    hashes = F.expr(
        f"if(size({words}) < 3, cast(array() as array<bigint>), transform(sequence(0, size({words}) - 3), "
        f"i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])))"
    )
    return hashes


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    text = F.col("_text")
    m = documents.select("doc_id", "lang", "source", text_of().alias("_text"))
    m = m.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    m = m.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD))))
    m = m.select(
        "doc_id", "lang", "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_words").alias("_windows"),
    )
    # most texts repeat no window; only the others sort theirs
    m = m.withColumn("_sorted", F.expr(
        "if(size(array_distinct(_windows)) = size(_windows), cast(array() as array<struct<h:bigint,i:int>>), "
        "sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))))"
    ))
    m = m.withColumn("_again", F.expr(
        "filter(_sorted, (x, k) -> (k > 0 and _sorted[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(_sorted) and _sorted[least(k + 1, size(_sorted) - 1)].h = x.h))"
    ))
    covered = F.expr("size(array_distinct(flatten(transform(_again, x -> array(x.i, x.i + 1, x.i + 2)))))")
    return m.withColumn("n_repeat_words", covered.cast("long")).drop("_windows", "_sorted", "_again")


def sketches(measures: DataFrame) -> DataFrame:
    """Counts per language, source, measure and leading digits of the value."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"_{k}").alias("value")) for k in MEASURES])
    spare = F.greatest(F.length(F.bin("value")) - DIGITS, F.lit(0))
    rows = measures.select("_lang", "_source", F.explode(values).alias("m")).select("_lang", "_source", "m.*")
    rows = rows.withColumn("_spare", spare).withColumn("digits", F.expr("shiftleft(shiftright(value, _spare), _spare)"))
    return rows.groupBy("_lang", "_source", "measure", "digits").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest and highest accepted value per ``keys`` and measure, with the documents counted."""
    order = Window.partitionBy(*keys, "measure").orderBy("digits")
    whole = Window.partitionBy(*keys, "measure")
    cum = sketch.groupBy(*keys, "measure", "digits").agg(F.sum("n").alias("n"))
    cum = cum.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col("digits")))
    q = cum.groupBy(*keys, "measure").agg(at(1).alias("_q1"), at(3).alias("_q3"), F.max("_all").alias("docs"))
    spread = F.element_at(F.create_map(*[F.lit(v) for k, m in MEASURES.items() for v in (k, m[2])]), F.col("measure"))
    reach = F.greatest(F.col("_q3") - F.col("_q1"), spread) * FENCE
    # an entry stands for all values with its leading digits, so the upper fence starts at its last one
    last = F.col("_q3") + F.expr(f"shiftleft(1L, greatest(length(bin(_q3)) - {DIGITS}, 0)) - 1L")
    return q.select(*keys, "measure", (F.col("_q1") - reach).alias("low"), (last + reach).alias("high"), "docs")


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: the accepted range of every measure."""
    sketch = cut_lineage(sketch)

    def flat(keys: list[str], level: str) -> DataFrame:
        f = fences(sketch, keys)
        cells = [
            F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"{level}_{k}_{c}") for k in MEASURES for c in ("low", "high")
        ]
        return f.groupBy(*keys).agg(F.max("docs").alias(f"{level}_docs"), *cells)

    groups = flat(["_lang", "_source"], "g").join(flat(["_lang"], "l"), "_lang").crossJoin(F.broadcast(flat([], "c")))
    pick = lambda c: (
        F.when(F.col("g_docs") >= MIN_DOCS, F.col(f"g_{c}")).when(F.col("l_docs") >= MIN_DOCS, F.col(f"l_{c}")).otherwise(F.col(f"c_{c}"))
    )
    return groups.select("_lang", "_source", *[pick(f"{k}_{c}").alias(f"{k}_{c}") for k in MEASURES for c in ("low", "high")])


def judged(documents: DataFrame) -> DataFrame:
    """Measures, base verdict and the verdict of the learned thresholds."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    m = measured(documents).withColumns({"_lang": key("lang"), "_source": key("source")})
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    m = stage(m.withColumn("base_failed", failed).withColumns({
        f"_{k}": F.floor(F.col(a) * UNIT / F.greatest(F.col(b), F.lit(1))).cast("long") for k, (a, b, _) in MEASURES.items()
    }))
    passed = m.filter(~F.col("base_failed"))
    sizes = m.groupBy("_lang", "_source").agg(F.count("*").alias("_rows"))
    limits = sizes.join(thresholds(sketches(passed)), ["_lang", "_source"], "left")
    bad = [(F.col(f"_{k}") > F.col(f"{k}_high")) | (F.col(f"_{k}") < F.col(f"{k}_low")) for k in MEASURES]
    ok = ~F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(False))
    return attach(m, limits, ["_lang", "_source"], weight="_rows").withColumn("kept", ~F.col("base_failed") & ok)


def document_verdicts(documents: DataFrame) -> DataFrame:
    return judged(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
