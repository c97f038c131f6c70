"""Planted bad cells and lines: what is typed and what is rejected add up to the file."""

from pyspark.sql import types as T

from hushframe.sources import registry

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v.x", T.DoubleType()), T.StructField("name", T.StringType())])


def spec(header, null_value=None):
    return registry.DatasetSpec("t", "t.csv", SCHEMA, lambda df: df, "id", header=header, null_value=null_value)


def test_cells_and_lines(spark, tmp_path):
    lines = ["id,v.x,name", "1,0.5,a", "two,1.5,b", "3,many,?", "4,?,d", "5,2.5", "6,3.5,f,extra", '"7"," 4.5 ","x, y"', "", "9223372036854775808,NaN,g", "x,y,z"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    rows, rejects = registry.read_checked(spark, spec(True, "?"), str(tmp_path / "t.csv"))
    assert rows.schema == SCHEMA
    got = [(r["id"], None if r["v.x"] != r["v.x"] else r["v.x"], r["name"]) for r in rows.collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0.5, "a"), (None, 1.5, "b"), (3, None, None), (4, None, "d"), (5, 2.5, None), (6, 3.5, "f"), (7, 4.5, "x, y"), (None, None, "g"), (None, None, "z")], key=str
    )
    bad = sorted(((r["column"], r["text"]) for r in rejects.collect()), key=str)
    assert bad == sorted(
        [("id", "two"), ("v.x", "many"), (None, "5,2.5"), (None, "6,3.5,f,extra"), ("id", "9223372036854775808"), ("id", "x"), ("v.x", "y")], key=str
    )
    assert all(r["file"].endswith("t.csv") and r["line"] for r in rejects.collect())
    # every cell is typed, null in the file, or rejected
    typed = sum(v is not None for r in rows.collect() for v in r)
    assert typed + sum(r["column"] is not None for r in rejects.collect()) == 9 * 3 - 3


def test_many_files_without_header(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"part{k}.csv").write_text("".join(f"{i},{'bad' if i % 10 == k else i / 2},n{i}\n" for i in range(100)))
    rows, rejects = registry.read_checked(spark, spec(False), str(tmp_path))
    assert rows.count() == 400 and rows.filter("`v.x` is null").count() == 40
    found = {(r["file"][-9:], r["n"]) for r in rejects.groupBy("file").count().withColumnRenamed("count", "n").collect()}
    assert found == {(f"part{k}.csv", 10) for k in range(4)} and {r["text"] for r in rejects.collect()} == {"bad"}
