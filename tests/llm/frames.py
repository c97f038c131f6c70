"""Rows with awkward values, shared by the tests of all operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over the lazy dog near a silent river while birds sing about spring".split()


def prose(n: int, start: int = 0) -> str:
    return " ".join(WORDS[(start + i * 7) % len(WORDS)] + (f"{start + i}" if i % 3 == 0 else "") for i in range(n))


EDGE = [
    (1, ""), (2, None), (None, "null id text"), (3, " \t\n "), (4, "Tie"), (5, "tie"), (6, "same row"), (6, "same row"), (-7, prose(80)),
    (2**60, prose(9_000, 3)), (8, "ünï cödé €\x00 \x1c x y"), (9, "a\r\n\r\nb   c\n\n\n d "), (10, prose(80) + " "),
]


def write(spark, tmp_path, rows, name="docs", parts=3, **extra):
    """A parquet table of (doc_id, text) rows; sources and languages follow the position unless given."""
    full = [
        (i, t, [None, "en", "de"][k % 3] if "lang" not in extra else extra["lang"], [None, "b", "a", "c"][k % 4] if "source" not in extra else extra["source"], len(t or ""))
        for k, (i, t) in enumerate(rows)
    ]
    path = str(tmp_path / name)
    spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)
