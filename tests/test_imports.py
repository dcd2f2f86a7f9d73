import pytest
from pyspark.sql import functions as F

from assayline.errors import DataQualityError, ImportRejected, SchemaRefused
from assayline.operators import columns, loading
from assayline.sources import delimited, snapshot
from assayline.sources.datasets import ColumnSpec, Datasets, check_definition, describe, to_schema


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_delimited_text_is_read_verbatim(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿Ref; Place of use ;Note\n001;"left;right";NA\n\n2;;"say ""hi"""\n')
    frame = delimited.check_lines(delimited.read_delimited(spark, path))
    assert frame.columns == ["Ref", "Place of use", "Note", "_row", "_file"]
    assert [tuple(r[:3]) for r in frame.orderBy("_row").collect()] == [("001", "left;right", "NA"), ("2", None, 'say "hi"')]
    assert frame.first()["_file"] == "a.csv"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_are_found(spark, tmp_path, sep):
    path = write(tmp_path, "b.csv", f"a{sep}b\n1{sep}2\n3{sep}4\n")
    assert [tuple(r) for r in delimited.read_delimited(spark, path).select("a", "b").collect()] == [("1", "2"), ("3", "4")]


def test_central_european_text(spark, tmp_path):
    path = write(tmp_path, "c.csv", "imię;miasto\nŻaneta;Łódź\nPaweł;Kraków\n", "cp1250")
    rows = delimited.read_delimited(spark, path).select("imię", "miasto").collect()
    assert [tuple(r) for r in rows] == [("Żaneta", "Łódź"), ("Paweł", "Kraków")]


def test_bad_files_are_refused(spark, tmp_path):
    for name, text in (("d.csv", "a;;b\n1;2;3\n"), ("e.csv", "a;A\n1;2\n")):
        with pytest.raises(ImportRejected):
            delimited.read_delimited(spark, write(tmp_path, name, text))
    for name, text in (("f.csv", "a;b\n1;2\n3\n"), ("g.csv", "a;b\n1;2\n3;4;5\n")):
        with pytest.raises(ImportRejected, match="3"):
            delimited.check_lines(delimited.read_delimited(spark, write(tmp_path, name, text)))


def test_export_defuses_formulas(spark, tmp_path):
    frame = spark.createDataFrame([(1, "=1+1"), (2, " @x"), (3, "a=b"), (-4, None)], "id int, v string")
    assert delimited.write_delimited(frame.coalesce(1), str(tmp_path / "out")) == 4
    back = spark.read.csv(str(tmp_path / "out"), sep=";", header=True).orderBy("id")
    assert sorted((r["id"], r["v"]) for r in back.collect()) == [("-4", None), ("1", "'=1+1"), ("2", "' @x"), ("3", "a=b")]
    delimited.write_delimited(frame, str(tmp_path / "raw"), spreadsheet=False)
    assert spark.read.csv(str(tmp_path / "raw"), sep=";", header=True).where("v = '=1+1'").count() == 1


def test_failed_records_of_one_run_are_exported(spark, tmp_path):
    rows = [("r1", "a", "1.0", "7", "f", "=x", 1, "bad"), ("r1", "a", "1.0", "8", "f", "y", 0, ""), ("r2", "a", "1.0", "9", "f", "z", 1, "bad")]
    frame = spark.createDataFrame(
        rows, "run_id string, rule_id string, rule_version string, record_id string, field_name string, field_value string,"
        " test_result int, error_message string")
    assert delimited.export_failures(frame, "r1", str(tmp_path / "e")) == 1
    assert spark.read.csv(str(tmp_path / "e"), sep=";", header=True).first()["field_value"] == "'=x"


def test_import_creates_updates_and_rejects_as_a_whole(spark, store):
    new = [ColumnSpec("id", "INTEGER"), ColumnSpec("code", "TEXT"), ColumnSpec("amount", "DECIMAL(10,2)"), ColumnSpec("note", "TEXT", True)]
    first = spark.createDataFrame([(0, "1", "001", "5.00", "a"), (1, "", "002", "", "b")], "_row int, id string, code string, amount string, note string")
    assert loading.import_rows(store, first, "items", "ann", file_name="one.csv", new_columns=new) == 2
    rows = {r["id"]: (r["code"], r["amount"], r["note"]) for r in store.read("items").collect()}
    assert set(rows) == {1, 2} and rows[1][0] == "001" and rows[2] == ("002", None, "b")
    second = spark.createDataFrame([(0, "2", "9.5", "c"), (1, "", "1", "d")], "_row int, id string, amount string, n string")
    loading.import_rows(store, second, "items", "ann", file_name="two.csv", mapping={"id": "id", "amount": "amount", "n": "note"})
    rows = {r["id"]: (r["code"], str(r["amount"]), r["note"]) for r in store.read("items").collect()}
    assert rows == {1: ("001", "5.00", "a"), 2: ("002", "9.50", "c"), 3: (None, "1.00", "d")}
    bad = [("bad", "x"), ("1.001", "x"), ("1", "")]
    for amount, note in bad:
        frame = spark.createDataFrame([(0, "1", "7", "ok"), (1, "2", amount, note)], "_row int, id string, amount string, note string")
        with pytest.raises(ImportRejected):
            loading.import_rows(store, frame, "items", "ann", file_name="x.csv")
    twice = spark.createDataFrame([(0, "1", "7", "a"), (1, "1", "8", "b")], "_row int, id string, amount string, note string")
    with pytest.raises(ImportRejected, match="occurs 2 times"):
        loading.import_rows(store, twice, "items", "ann", file_name="x.csv")
    assert store.version("items") == 2
    log = loading.latest_loads(store.history("load_log", snapshot.LOAD_LOG)).collect()
    assert [(r["table_name"], r["file_name"], r["row_count"]) for r in log] == [("items", "two.csv", 2)]


def test_ids_are_never_used_twice(spark, store):
    store.save("t", spark.createDataFrame([(100, "a")], "id bigint, v string"))
    store.save("t", spark.createDataFrame([(1, "b")], "id bigint, v string"))
    batch = spark.createDataFrame([(0, "c")], "_row int, v string")
    loading.import_rows(store, batch, "t", "ann", file_name="f")
    assert {r["id"] for r in store.read("t").collect()} == {1, 101}


def test_row_numbers_are_consecutive(spark):
    frame = spark.range(1000).repartition(7).select(F.col("id").alias("v"))
    ids = sorted(r["n"] for r in loading.number_rows(frame, "n", 50).collect())
    assert ids == list(range(51, 1051))
    assert loading.number_rows(frame.limit(0), "n", 3).count() == 0


@pytest.mark.parametrize(
    "mapping",
    [{"a": "a"}, {"a": "", "b": "b"}, {"a": None, "b": None}, {"a": "x", "b": "x"}, {"a": "a", "b": "zzz"}, {"a": None, "b": "b"}],
)
def test_bad_mappings_are_refused(mapping):
    specs = [ColumnSpec("a", required=True), ColumnSpec("b"), ColumnSpec("x")]
    with pytest.raises(ImportRejected):
        loading.check_mapping(["a", "b"], specs, mapping)


def test_definitions_are_checked():
    assert [c.name for c in check_definition("t", [ColumnSpec("a")])] == ["id", "a"]
    bad = [("1t", [ColumnSpec("a")]), ("dq_x", [ColumnSpec("a")]), ("sqlite_x", [ColumnSpec("a")]), ("t", []),
           ("t", [ColumnSpec("a"), ColumnSpec("A")]), ("t", [ColumnSpec("a b")]), ("t", [ColumnSpec("a", "MAP")]),
           ("t", [ColumnSpec("ID")]), ("t", [ColumnSpec("id", "DATE")])]
    for table, specs in bad:
        with pytest.raises(SchemaRefused):
            check_definition(table, specs)


def test_datasets_are_listed_and_described(spark):
    known = Datasets(spark, {"people": spark.createDataFrame([(1, "a")], "id bigint, v string")})
    assert known.names() == ["people"] and [(c.name, c.kind, c.pk) for c in known.columns("people")] == [
        ("id", "BIGINT", True), ("v", "STRING", False)]
    with pytest.raises(SchemaRefused):
        known.scan("other")
    with pytest.raises(SchemaRefused):
        known.add("dq_runs", known.scan("people"))


def test_snapshot_names(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4)], "`id` int, `source_id` int, `Amount €` int, `9x` int")
    assert [c.name for c in snapshot.snapshot_columns(frame.schema)] == ["source_id", "source_id_2", "Amount__", "col_9x"]
    with pytest.raises(SchemaRefused):
        snapshot.snapshot_columns(frame.schema, preserve_names=True)
    with pytest.raises(SchemaRefused):
        snapshot.snapshot_columns(spark.createDataFrame([([1],)], "a array<int>").schema)


def test_snapshot_is_saved_and_refreshed_only_from_its_source(spark, store):
    source = spark.createDataFrame([(7, "Ada"), (7, ""), (None, None)], "id int, name string")
    assert snapshot.save_snapshot(store, source, "people", "ref-1", "ann") == 3
    rows = sorted(tuple(r) for r in store.read("people").fillna("<null>").fillna(-1).collect())
    assert [r[0] for r in rows] == [1, 2, 3] and sorted(r[1:] for r in rows) == [(-1, "<null>"), (7, ""), (7, "Ada")]
    assert snapshot.save_snapshot(store, source.limit(1), "people", "ref-1", "ann", replace=True) == 1
    with pytest.raises(SchemaRefused, match="another source"):
        snapshot.save_snapshot(store, source, "people", "ref-2", "ann", replace=True)
    with pytest.raises(SchemaRefused, match="differ"):
        snapshot.save_snapshot(store, source.withColumn("x", F.lit(1)), "people", "ref-1", "ann", replace=True)
    with pytest.raises(SchemaRefused, match="there already"):
        snapshot.save_snapshot(store, source, "people", "ref-1", "ann")


def test_named_snapshot_needs_unique_ids(spark, store):
    source = spark.createDataFrame([(7, "Ada"), (9, "Ben")], "id int, name string")
    snapshot.save_snapshot(store, source, "kept", "ref", "ann", preserve_names=True)
    assert {r["id"] for r in store.read("kept").collect()} == {7, 9}
    for bad in (source.union(source), source.withColumn("id", F.lit("x"))):
        with pytest.raises(SchemaRefused):
            snapshot.save_snapshot(store, bad, "other", "ref", "ann", preserve_names=True)


def test_publish_verifies_rows_and_never_replaces_silently(spark, store):
    frame = spark.range(5).withColumn("v", F.lit("x"))
    store.publish("t", frame, 5)
    with pytest.raises(SchemaRefused):
        store.publish("t", frame, 5)
    with pytest.raises(Exception, match="5 rows were written"):
        store.publish("t", frame, 6, replace=True)
    with pytest.raises(Exception, match="Stopped"):
        store.publish("t", frame, 5, replace=True, cancelled=lambda: True)
    assert store.versions("t") == [1] and store.publish("t", frame, 5, replace=True) == 2


RULE = "SELECT id, age, CASE WHEN age > 18 THEN 0 ELSE 1 END AS dq_check FROM people"


@pytest.fixture
def people(spark, store):
    specs = check_definition("people", [ColumnSpec("id", "INTEGER"), ColumnSpec("age", "TEXT"), ColumnSpec("code", "TEXT")])
    rows = [(1, "20", "001"), (2, "30", "x"), (3, None, None)]
    store.save("people", spark.createDataFrame(rows, to_schema(specs)))
    return store.read("people")


def test_column_edits(store, people):
    columns.edit(store, "people", "add", {"r": RULE}, name="extra", kind="DATE")
    assert describe(store.read("people"))[-1].kind == "DATE"
    columns.edit(store, "people", "modify", {"r": RULE}, name="code", new_name="label", kind="STRING")
    columns.edit(store, "people", "drop", {"r": RULE}, name="extra")
    assert store.read("people").columns == ["id", "age", "label"]
    columns.edit(store, "people", "modify", {}, name="age", kind="INTEGER")
    assert [r["age"] for r in store.read("people").orderBy("id").collect()] == [20, 30, None]
    assert store.read("people", 1).columns == ["id", "age", "code"]


@pytest.mark.parametrize(
    "action, change, rules",
    [
        ("drop", {"name": "age"}, {"r": RULE}),
        ("modify", {"name": "age", "kind": "INTEGER"}, {"r": RULE}),
        ("drop", {"name": "code"}, {"r": "SELECT broken FROM people"}),
        ("add", {"name": "n"}, {"r": "SELECT *, 0 AS dq_check FROM people"}),
        ("modify", {"name": "code", "kind": "INTEGER"}, {}),
        ("modify", {"name": "age", "required": True}, {}),
        ("drop", {"name": "id"}, {}),
        ("add", {"name": "AGE"}, {}),
        ("add", {"name": "n", "required": True}, {}),
        ("drop", {"name": "nothing"}, {}),
        ("add", {"name": "n", "kind": "MAP"}, {}),
    ],
)
def test_unsafe_edits_are_refused(store, people, action, change, rules):
    with pytest.raises(SchemaRefused):
        columns.edit(store, "people", action, rules, **change)
    assert store.versions("people") == [1]


def test_alignment_keeps_every_value(spark):
    old = spark.createDataFrame([(7, "001", "2026-09-24", "123.40", 1)], "id int, sku string, day string, price string, active int")
    kinds = {"sku": "STRING", "day": "DATE", "price": "DECIMAL(10,2)", "active": "BOOLEAN"}
    aligned, changes = columns.align_types(old, kinds)
    assert {c[0] for c in changes} == {"day", "price", "active"}
    row = aligned.first()
    assert (row["sku"], str(row["day"]), str(row["price"]), row["active"]) == ("001", "2026-09-24", "123.40", True)
    odd = spark.createDataFrame([(1, "'-99.99", 2)], "id int, price string, active int")
    wanted = {"price": "DECIMAL(10,2)", "active": "BOOLEAN"}
    with pytest.raises(SchemaRefused):
        columns.align_types(odd, wanted)
    kept, _ = columns.align_types(odd, wanted, preserve_invalid=True)
    assert tuple(kept.first()) == (1, "'-99.99", "2")
    with pytest.raises(SchemaRefused):
        columns.align_types(odd, {"price": "TEXT"})


def cells(frame, n):
    return sorted(tuple(r[:n]) for r in frame.collect())


def test_quoted_line_breaks_stay_one_record(spark, tmp_path):
    path = write(tmp_path, "breaks.csv", 'k;v\n1;"two\n9;lines"\n2;plain\n')
    assert cells(delimited.check_lines(delimited.read_delimited(spark, path)), 2) == [("1", "two\n9;lines"), ("2", "plain")]


def test_long_headers_are_read_whole(spark, tmp_path):
    names = [f"column_number_{i:06d}_of_many" for i in range(3000)]
    path = write(tmp_path, "wide.csv", ";".join(names) + "\n" + ";".join("x" for _ in names) + "\n")
    frame = delimited.read_delimited(spark, path)
    assert frame.columns[:3000] == names


def test_every_file_must_have_the_same_header(spark, tmp_path):
    write(tmp_path, "a.csv", "k;v;w\n1;a;x\n")
    write(tmp_path, "b.csv", "w;k;v\ny;2;b\n")
    with pytest.raises(ImportRejected, match="b.csv"):
        delimited.read_delimited(spark, str(tmp_path))


def test_bad_lines_are_named_by_their_number(spark, tmp_path):
    path = write(tmp_path, "bad.csv", "k;v\n1;a\n2;b\n3;c;too many\n")
    with pytest.raises(ImportRejected, match="Record 4 of bad.csv"):
        delimited.check_lines(delimited.read_delimited(spark, path))


def test_exports_begin_with_the_mark_of_utf8(spark, tmp_path):
    frame = spark.createDataFrame([(1, "é")], "k int, v string")
    delimited.write_delimited(frame, str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv" and p.stat().st_size]
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in files)
    assert cells(delimited.check_lines(delimited.read_delimited(spark, str(tmp_path / "out"))), 2) == [("1", "é")]


def test_two_writers_never_share_a_version(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    from assayline.sources.tables import TableStore

    def write(n):
        other = TableStore(spark, store.root)
        return n, other.save("t", spark.range(n + 1))

    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(write, range(18)))
    assert sorted(version for _, version in made) == list(range(1, 19)) == store.versions("t")
    assert all(store.read("t", version).count() == n + 1 == store.manifest("t", version)["rows"] for n, version in made)

    def create(n):
        try:
            return TableStore(spark, store.root).save("once", spark.range(n), create=True)
        except SchemaRefused:
            return None

    with ThreadPoolExecutor(6) as pool:
        assert sorted(filter(None, pool.map(create, range(6)))) == [1]
    assert len(store._folders(f"{store.root}/datasets/once/data")) == 1


def test_a_failed_write_leaves_nothing_behind(spark, store):
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("int").alias("a"))
    with pytest.raises(Exception, match="stop"):
        store.save("t", broken)
    with pytest.raises(DataQualityError, match="announced"):
        store.publish("t", spark.range(3), 4)
    assert store.versions("t") == [] and store._folders(f"{store.root}/datasets/t/data") == []


def test_a_moment_pins_every_table(spark, store):
    from datetime import datetime, timezone

    store.save("a", spark.range(1))
    before = datetime.now(timezone.utc)
    store.save("a", spark.range(2))
    store.save("b", spark.range(5).withMetadata("id", {"note": "kept"}))
    assert store.as_of(before) == {"a": 1} and store.as_of(datetime.now(timezone.utc)) == {"a": 2, "b": 1}
    assert store.as_of(before.replace(tzinfo=None)) == {"a": 1}
    assert store.read("b").schema["id"].metadata == {"note": "kept"}
    with pytest.raises(DataQualityError, match="no version"):
        store.read("a", 9)


def test_numbers_are_reserved_once(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    from assayline.sources.tables import TableStore

    with ThreadPoolExecutor(6) as pool:
        starts = list(pool.map(lambda _: TableStore(spark, store.root).reserve("x", 5), range(12)))
    assert sorted(starts) == list(range(0, 60, 5)) and store.highest("x") == 60
    assert store.reserve("x", 1, 100) == 100 and store.highest("x") == 101 and store.highest("y") == 0


def test_partition_values_survive_a_path(spark, store):
    for value in ("a/b", "x=y", "50%", 'q"t', "ü ß"):
        store.append("log", spark.range(1), key=value)
    assert sorted(r["key"] for r in store.history("log", "id bigint, key string").collect()) == sorted(("a/b", "x=y", "50%", 'q"t', "ü ß"))
