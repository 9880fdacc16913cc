from codeweft.operators.heavy import callers_per_name, heavy_names

ROWS = "file string, name string, line_start int, calls array<string>, extra string"


def test_pairs_count_once(spark):
    rows = [
        ("a", "f", 1, [" x", "x\t", "\u00a0x", "", None, "y"], "1"), ("a", "f", 1, ["x", "z"], "2"), ("a", "g", 1, ["x"], "1"),
        ("a", "__file__", 1, ["x"], None), ("b", None, None, ["x"], None), ("c", "h", 2, None, None), ("c", "h", 2, [], None),
    ]
    df = spark.createDataFrame(rows, ROWS)
    assert {r.callee: r.callers for r in callers_per_name(df).collect()} == {"x": 3, "y": 1, "z": 1}
    assert {r.callee for r in heavy_names(df, 30).collect()} == {"x"}
    assert {r.callee for r in heavy_names(df, 20).collect()} == {"x", "y", "z"}


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert callers_per_name(df).count() == heavy_names(df).count() == 0
