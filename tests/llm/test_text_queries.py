"""The text queries: against SQL where there is one, and the pipeline's stages against plain Python."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from assayline.llm.common import written  # noqa: E402
from assayline.llm.queries import QUERIES, SQL  # noqa: E402

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("ASSAYLINE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = connection.execute(SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    plain = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(row[found.index(n)]) for n in names) for row in result.fetchall())
    assert sorted(tuple(map(plain, row)) for row in frame.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_whole_tables(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert {"doc_id"} <= set(rows.columns)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if not name.startswith("op6"):
        assert rows.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages_keep_columns_and_only_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, FOLDER), "test-stage")
        assert after.columns == names
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).toPandas()
    assert set(packed.doc_id) == {row.doc_id for row in docs.select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_pipeline_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "test-run")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(docs.select(*columns).collect()) == sorted(corpus_pipeline.run(spark, FOLDER).select(*columns).collect())


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "test-empty")
        assert docs.count() == 0


ODD = [
    (1, None, None, None, None), (None, "no id at all but several words in this line", "en", "s", 1), (None, None, None, "s", 0),
    (2, "", "en", None, 0), (3, "same words here again and again for everyone", "en", "s", 44), (3, "same words here again and again for everyone", "en", "s", 44),
    (4, "same words here again and again for everyone", "en", "s", 44), (5, " \n\t ", "en", "s", 4), (6, "w " * 40_000, "en", "s", 80_000),
]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, leaks int, row string, packed string, n_lines long, toxic string, carried int, lines string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names operators use themselves."""
    return written(spark.createDataFrame([(*row, 0.5, 9, 7, "r", "p", 8, "mine", 6, "l") for row in ODD], FIELDS), "odd")


def test_stages_take_odd_rows(spark, odd):
    docs, counts = odd, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), "test-odd")
        assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        own = docs.select("score", "shard", "leaks", "row", "packed", "n_lines", "toxic", "carried", "lines").distinct().collect()
        assert [tuple(r) for r in own] == [(0.5, 9, 7, "r", "p", 8, "mine", 6, "l")]
        counts.append(docs.count())
    # The copies lose their line; row 3 stays twice through line dedup and once after near-duplicates.
    assert counts[0] == counts[1] == len(ODD) and counts[2] == len(ODD) - 1
    texts = sorted((row.doc_id or 0, row.text or "") for row in docs.collect())
    assert (4, "") in texts and (3, "same words here again and again for everyone") in texts
    packed = written(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER), "test-odd").toPandas()
    assert packed.length.sum() == sum(len(t.split()) + 1 for _, t in texts)


def test_line_stage_takes_out_short_repeats(spark):
    unspaced = "\u8fd9\u4e00\u884c\u6ca1\u6709\u7a7a\u683c" * 5
    rows = [(1, f"Read more\n\n{unspaced}\nok\n \nfirst"), (2, f"read  MORE\n\n{unspaced}\nsecond\nok\n "), (3, "ok\nthird line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = dict(corpus_pipeline.drop_repeated_lines(spark, docs, FOLDER).collect())
    assert cleaned == {1: rows[0][1], 2: "\nsecond\n ", 3: "third line"}
