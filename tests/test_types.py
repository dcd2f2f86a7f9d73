import pytest
from pyspark.sql import functions as F, types as T

from assayline.errors import SchemaRefused
from assayline.functions import datatypes
from assayline.functions.text import percent_text
from assayline.operators import audits, loading
from assayline.sources.datasets import ColumnSpec


def accepted(spark, kind, *texts):
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    return [r[0] for r in frame.select(datatypes.cell_reason(F.col("v"), kind).isNull()).collect()]


GOOD = [
    ("BIGINT", "12"), ("STRING", "0000123"), ("DECIMAL(10,2)", "123.40"), ("DECIMAL(8,3)", "0.001"), ("BOOLEAN", "true"),
    ("BOOLEAN", "0"), ("DATE", "2026-09-24"), ("TIMESTAMP", "2026-09-24T12:30:00"), ("TIMESTAMP", "2026-09-24 12:30:00.5Z"),
    ("TIMESTAMP", "2026-09-24T12:30:00+02:00"), ("TIMESTAMP_NTZ", "2026-09-24T12:30:00"), ("INT", " +5 "), ("TINYINT", "-128"),
    ("DECIMAL(38,2)", "9" * 36 + ".99"), ("DECIMAL(10,2)", "00000000000000001.10000"), ("REAL", "1e5"), ("REAL", ".5"),
    ("DECIMAL(2,2)", "0.99"),
]
BAD = [
    ("DATE", "2026-02-30"), ("DATE", "24/09/2026"), ("DATE", "2026-09-24T12:00:00"), ("DATE", "2026-09"), ("TIMESTAMP", "2026-09-24"),
    ("TIMESTAMP", "2026-09-24T25:00:00"), ("TIMESTAMP_NTZ", "2026-09-24T12:00:00Z"), ("DECIMAL(10,2)", "1.001"),
    ("DECIMAL(10,2)", "100000000.00"), ("DECIMAL(10,2)", "NaN"), ("DECIMAL(10,2)", "1."), ("BOOLEAN", "2"), ("BOOLEAN", "yes"),
    ("INTEGER", "2.5"), ("INTEGER", "bad"), ("INTEGER", str(2**63)), ("TINYINT", "128"), ("REAL", "nan"), ("REAL", "1e500"),
    ("REAL", "1d"), ("REAL", "1_0"), ("DECIMAL(2,2)", "1.00"), ("TIMESTAMP", "2026-09-24T12:00:00.1234567"),
]


def test_accepted_and_refused_cells(spark):
    rows = [(i, kind, text) for i, (kind, text) in enumerate(GOOD + BAD)]
    results = {}
    for kind in {k for _, k, _ in rows}:
        mine = [(i, text) for i, k, text in rows if k == kind]
        for (i, _), ok in zip(mine, accepted(spark, kind, *[t for _, t in mine])):
            results[i] = ok
    assert [results[i] for i in range(len(rows))] == [True] * len(GOOD) + [False] * len(BAD)


def test_exact_values_survive(spark):
    frame = spark.createDataFrame([("9" * 36 + ".99", "0000123", "2026-09-24T12:30:00.000001")], "d string, s string, t string")
    row = frame.select(
        datatypes.cell_value(F.col("d"), "DECIMAL(38,2)").cast("string"), datatypes.cell_value(F.col("s"), "STRING"),
        datatypes.cell_value(F.col("t"), "TIMESTAMP_NTZ").cast("string"),
    ).first()
    assert tuple(row) == ("9" * 36 + ".99", "0000123", "2026-09-24 12:30:00.000001")


def test_empty_cells_are_null_or_required(spark):
    frame = spark.createDataFrame([("",), (None,), ("x",)], "v string")
    plain, needed, filled = (
        [r[0] for r in frame.select(datatypes.cell_reason(F.col("v"), *args)).collect()]
        for args in (("TEXT",), ("TEXT", True), ("TEXT", True, "default"))
    )
    assert plain == [None] * 3 and filled == [None] * 3
    assert needed == ["a value is required", "a value is required", None]


def lossless(spark, kind, values, schema="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"v {schema}")
    return [r[0] for r in frame.select(datatypes.lossless(F.col("v"), frame.schema["v"].dataType, kind)).collect()]


def test_lossless_refuses_every_kind_of_change(spark):
    assert lossless(spark, "INTEGER", ["001", "12.5", "", " 2", str(2**63), "1e-1"]) == [False] * 6
    assert lossless(spark, "INTEGER", ["1", "-7", "12.0", "1e3", "100e-2", "0", None, str(2**63 - 1)]) == [True] * 8
    assert lossless(spark, "REAL", ["bad", "NaN", "1e500", "9007199254740993", "0.1234567890123456789", "1e23"]) == [False] * 6
    assert lossless(spark, "REAL", ["0.5", "-2", "1e20", "9007199254740992", "123.456", "0", "1.50", "1e22"]) == [True] * 8
    assert lossless(spark, "TINYINT", ["127", "128"]) == [True, False]
    assert lossless(spark, "DECIMAL(10,2)", [1.2], "double") == [False]
    assert lossless(spark, "DECIMAL(10,2)", [7], "bigint") == [True]
    assert lossless(spark, "REAL", [2**53, 2**53 + 1], "bigint") == [True, False]
    assert lossless(spark, "INTEGER", [1.0, 1.5], "double") == [True, False]
    assert lossless(spark, "BOOLEAN", [0, 1, 2], "int") == [True, True, False]
    assert lossless(spark, "INTEGER", [True], "boolean") == [False]
    assert lossless(spark, "STRING", [b"x"], "binary") == [False]


def test_converted_values(spark):
    frame = spark.createDataFrame([("1e3", "2026-01-02", "12.50")], "a string, b string, c string")
    row = frame.select(
        datatypes.convert(F.col("a"), T.StringType(), "INTEGER"), datatypes.convert(F.col("b"), T.StringType(), "DATE").cast("string"),
        datatypes.convert(F.col("c"), T.StringType(), "DECIMAL(10,2)").cast("string"),
    ).first()
    assert tuple(row) == (1000, "2026-01-02", "12.50")


def test_unknown_kinds_are_refused():
    for kind in ("MAP", "DECIMAL(39,1)", "DECIMAL(2,3)", "DECIMAL(0,0)"):
        with pytest.raises(SchemaRefused):
            datatypes.spark_type(kind)


def test_suggested_kinds(spark):
    rows = [("1", "001", "1.5", "a", "", "1e400"), ("22", "7", "2", "1", " ", "2"), ("-3", "8", "", "2", None, "3")]
    frame = spark.createDataFrame(rows, "w string, z string, r string, t string, e string, i string")
    got = {r[0]: r[1] for r in loading.infer_kinds(frame).collect()}
    assert got == {"w": "INTEGER", "z": "TEXT", "r": "REAL", "t": "TEXT", "e": "TEXT", "i": "TEXT"}


def test_upload_audit_and_samples(spark):
    frame = spark.createDataFrame([(1, "x", "1"), (2, "5", "2026-01-01"), (3, None, "q")], "id int, n string, d string")
    kinds = {"n": "INTEGER", "d": "DATE"}
    got = {r["column_name"]: (r["kind"], r["accepted"], r["refused"]) for r in audits.upload_audit(frame, kinds).collect()}
    assert got == {"n": ("INTEGER", 1, 1), "d": ("DATE", 1, 2)}
    text = {r["column_name"]: r["refused"] for r in audits.upload_audit(frame, kinds, ["d"]).collect()}
    assert text == {"n": 1, "d": 0}
    samples = [(r["record"], r["column_name"], r["value"]) for r in audits.refused_samples(frame, kinds, "id").collect()]
    assert samples == [(1, "d", "1"), (1, "n", "x"), (3, "d", "q")]
    with pytest.raises(SchemaRefused):
        audits.upload_audit(frame, kinds, ["id"])


def test_equality_counts_repeated_rows(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    two = spark.createDataFrame([(1, None), (2, "a"), (2, "a")], "k int, v string")
    assert audits.tables_equal(one, one).first()["equal"]
    assert tuple(audits.tables_equal(one, two).first()) == (3, 3, 1, 1, False)
    assert sorted(map(tuple, audits.differences(one, two).collect()), key=str) == [(1, None, 2, 1), (2, "a", 1, 2)]
    assert audits.probably_equal(one, one) and not audits.probably_equal(one, two)


def test_percent_text_rounds_like_printf(spark):
    values = [100.0 * p / n for n in (3, 7, 16, 32, 97, 400, 2000) for p in range(n + 1)] + [12.25, 12.75, 33.45, 0.05, 0.25, 0.15]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in frame.select(percent_text(F.col("v"))).collect()]
    assert got == [f"{v:.1f}%" for v in values]


def test_conversion_of_cells_reports_all_issues(spark):
    frame = spark.createDataFrame([(2, "1", "x"), (3, "b", ""), (4, "2.5", "y")], "_row int, n string, t string")
    pairs = [("n", ColumnSpec("num", "INTEGER")), ("t", ColumnSpec("txt", "TEXT", required=True))]
    converted = loading.convert_cells(frame, pairs, ["_row"])
    assert [(r["num"], r["txt"]) for r in converted.collect()] == [(1, "x"), (None, None), (None, "y")]
    assert [(r[0], r[1]) for r in loading.cell_issues(converted, "_row").orderBy("_row", "column_name").collect()] == [
        (3, "num"), (3, "txt"), (4, "num")
    ]


def test_equal_tables_move_no_rows(spark):
    frame = spark.range(5000).selectExpr("id % 700 AS a", "concat('x', id % 13) AS b", "cast(id % 3 AS double) AS c")
    found = audits.tables_equal(frame, frame)
    assert tuple(found.first()) == (5000, 5000, 0, 0, True)
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    final = plan.toString().split("Initial Plan")[0]
    assert "hashpartitioning(a" not in final  # whole rows are a key of no exchange that ran
    other = frame.withColumn("c", F.when(F.col("a") == 5, F.lit(9.0)).otherwise(F.col("c")))
    moved = frame.where("a = 5 AND c <> 9").count()
    assert tuple(audits.tables_equal(frame, other).first()) == (5000, 5000, moved, moved, False)
    assert tuple(audits.tables_equal(frame.limit(0), other).first()) == (0, 5000, 0, 5000, False)
    assert tuple(audits.tables_equal(frame.limit(0), frame.limit(0)).first()) == (0, 0, 0, 0, True)


def test_line_diff_is_a_longest_common_subsequence(spark):
    import random

    from assayline.operators.library import line_diff

    pick = random.Random(4)
    pairs = [(None, "a"), ("a", None), ("", ""), ("a", "a"), ("a\nb", "b"), ("a", "a\na"), (None, None), ("x\ny\nz", "p\nq")]
    for _ in range(120):
        old = [pick.choice("abcde") for _ in range(pick.randrange(9))]
        new = [pick.choice("abcde") for _ in range(pick.randrange(9))] if pick.random() < 0.4 else [c for c in old if pick.random() < 0.8] + ["e"] * pick.randrange(2)
        pairs.append(("\n".join(old), "\n".join(new)))
    frame = spark.createDataFrame(list(enumerate(pairs)), "n int, p struct<o: string, n: string>").repartition(4)
    for row in frame.select("p", line_diff(F.col("p.o"), F.col("p.n")).alias("d")).collect():
        a, b = ([] if text is None else text.split("\n") for text in (row.p.o, row.p.n))
        assert [c.line for c in row.d if c.kind != "added"] == a and [c.line for c in row.d if c.kind != "removed"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        assert sum(c.kind == "kept" for c in row.d) == best[0][0]
