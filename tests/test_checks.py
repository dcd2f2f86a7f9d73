import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayline.errors import DataQualityError
from assayline.functions.text import accent_key, regex_matches, text_equal
from assayline.operators import checks, suite
from assayline.operators.crossref import CrossReference
from assayline.operators.evaluate import evaluate

PAIRS = (("zone", "zone"), ("unit", "tariff_unit"))


def fails(frame, check):
    return sorted(r["id"] for r in checks.rows(frame, check).where("dq_check = 1").collect())


def meter_checks():
    return [
        checks.required("label").named(1, "label given", "No label"),
        checks.like("serial", "__-%").named(2, "serial form", "Serial is not of the usual form"),
        checks.between("load", 0, 250).named(3, "load range", "Load is beyond the meter"),
        checks.unique("serial").named(4, "serial unique", "Serial occurs twice"),
    ]


def parcel_checks():
    return [
        checks.unique("code").named(5, "code unique"),
        checks.required("note").named(6, "note given"),
        checks.positive("weight").named(7, "weight positive"),
        checks.date_text("sent").named(8, "sent on a day"),
    ]


def test_planted_failures_are_found(meters, parcels):
    assert [fails(meters, c) for c in meter_checks()] == [[202, 204], [203, 206], [203, 204, 205], [201, 205, 206, 207, 208]]
    assert [fails(parcels, c) for c in parcel_checks()] == [[302, 303], [303], [302, 303, 304], [302, 303, 304]]


def test_fused_suite_equals_single_checks(meters):
    fused = suite.fuse(meters, meter_checks())
    counts = {r["rule_id"]: (r["passed"], r["failed"]) for r in fused.counts().collect()}
    assert counts == {1: (6, 2), 2: (6, 2), 3: (5, 3), 4: (3, 5)}
    evidence = Counter(r["rule_id"] for r in fused.evidence().collect())
    assert evidence == {1: 2, 2: 2, 3: 3, 4: 5}
    everything = fused.evidence(failures_only=False)
    assert everything.count() == 32
    assert everything.where("test_result = 0 AND error_message <> ''").count() == 0
    assert everything.where("rule_id = 1 AND test_result = 1").first()["error_message"] == "No label"


@pytest.mark.parametrize(
    "options, passed",
    [({}, 1), ({"normalize": True}, 3), ({"nulls": "skip"}, 2), ({"mode": "missing"}, 4)],
)
def test_cross_table_truth_table(spark, shipments, tariffs, options, passed):
    spec = CrossReference("tariffs", PAIRS, active_column="in_force", **options)
    check = checks.cross_reference(spec, tariffs)
    assert 6 - len(fails(shipments, check)) == passed
    text = evaluate(spark, spec.sql(), {"source": shipments, "tariffs": tariffs})
    assert text.field == "zone"
    assert text.frame.where("dq_check = 0").count() == passed
    assert text.frame.count() == 6
    assert CrossReference.from_dict(spec.to_dict()) == spec


@pytest.mark.usefixtures("no_broadcast")
@pytest.mark.parametrize("options, passed", [({}, 1), ({"nulls": "skip"}, 2), ({"mode": "missing"}, 4)])
def test_cross_table_on_the_shuffled_route(shipments, tariffs, options, passed):
    spec = CrossReference("tariffs", PAIRS, active_column="in_force", **options)
    assert 6 - len(fails(shipments, checks.cross_reference(spec, tariffs))) == passed


@pytest.mark.parametrize(
    "change",
    [{"reference": "Bad Alias"}, {"pairs": ()}, {"pairs": (("id", "x"),)}, {"mode": "other"}, {"nulls": "x"},
     {"pairs": (("a", "b"),) * 13}, {"normalize": 1}, {"active_column": ""}],
)
def test_bad_cross_table_specs_are_refused(change):
    with pytest.raises(DataQualityError):
        CrossReference(**{"reference": "tariffs", "pairs": PAIRS, **change})


@pytest.mark.usefixtures("no_broadcast")
def test_uniqueness_with_a_hot_key_matches_brute_force(spark):
    pick = random.Random(7)
    values = ["hot"] * 700 + [None] * 300 + [" HOT "] * 20 + [f"v{pick.randrange(900)}" for _ in range(1000)] + [""] * 5
    pick.shuffle(values)
    frame = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    seen = Counter(v.strip().lower() for v in values if v is not None and v.strip())
    wanted = [i for i, v in enumerate(values) if v is None or not v.strip() or seen[v.strip().lower()] > 1]
    assert fails(frame, checks.unique("v")) == wanted


@pytest.mark.usefixtures("no_broadcast")
def test_composite_uniqueness(spark):
    rows = [(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, None, 2), (5, 2, 1)]
    frame = spark.createDataFrame(rows, "id int, a int, b int")
    assert fails(frame, checks.unique("a", "b")) == [1, 2, 4]


def test_null_and_threshold_checks(spark):
    frame = spark.createDataFrame([(1, 19, "5"), (2, 18, "x"), (3, None, "-1")], "id int, age int, t string")
    assert fails(frame, checks.not_null("age")) == [3]
    assert fails(frame, checks.threshold("age", ">", 18)) == [2, 3]
    assert fails(frame, checks.positive("t")) == [2, 3]
    assert fails(frame, checks.condition("age", "age > 18 OR id = 3")) == [2]


def test_patterns_ignore_case_unless_told(spark):
    frame = spark.createDataFrame([("Abc\nDEF",), (None,)], "v string")
    tests = [("abc", ""), ("abc", "c"), ("^def", ""), ("^def", "m"), ("c.d", ""), ("c.d", "n"), ("ABC", "ci")]
    rows = frame.select(*[regex_matches(F.col("v"), p, o).alias(f"t{i}") for i, (p, o) in enumerate(tests)]).collect()
    assert list(rows[0]) == [True, False, False, True, False, True, True]
    assert list(rows[1]) == [None] * 7
    with pytest.raises(DataQualityError):
        regex_matches(F.col("v"), "a", "z")


def test_accent_insensitive_equality(spark):
    pairs = [("Żółć", "zołc", True), ("Żółć", "zolc", False), ("Zürich", "ZURICH", True), ("Łódź", "lodz", False), ("Łódź", "łodz", True),
             ("Ørsted", "orsted", False), ("æ", "ae", False), ("José", "jose", True)]
    frame = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r[0] for r in frame.select(text_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [same for _, _, same in pairs]
    assert frame.groupBy(accent_key(F.col("b"))).count().count() == len(pairs)


def _plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_shuffled_route_merges_whatever_the_sizes(spark):
    from assayline.operators.skew import shuffled_route

    frame = spark.range(9000).selectExpr("id", "id % 3000 AS k", "cast(id % 6000 AS string) AS word")
    reference = spark.range(0, 3000, 2).selectExpr("id AS k")  # more keys than are looked up on their own
    suite_ = [checks.unique("k", "word").named(1, "u"), checks.cross_reference(CrossReference("known", (("k", "k"),)), reference).named(2, "x")]
    plain = suite.fuse(frame, suite_)
    with shuffled_route():
        forced = suite.fuse(frame, suite_)
    for one, other in ((plain.counts(), forced.counts()), (plain.evidence(), forced.evidence())):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
        assert "SortMergeJoin" in _plan(other).split("Initial Plan")[0]
    assert _plan(forced.evidence()).split("Initial Plan")[0].count("SortMergeJoin") == 2


def test_uniqueness_is_counted_without_a_join(spark):
    rows = [(i, None if i % 11 == 0 else " " if i % 7 == 0 else ("Long " * 40 if i % 5 == 0 else "long " * 40) + str(i % 30), i % 4) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, word string, n int")
    fused = suite.fuse(frame, [checks.unique("word").named(1, "a"), checks.unique("word", "n").named(2, "b"), checks.unique("id").named(3, "c")])
    counted = {r.rule_id: r.failed for r in fused.counts().collect()}
    assert counted == {1: fused.evidence().where("rule_id = 1").count(), 2: fused.evidence().where("rule_id = 2").count(), 3: 0}
    plan = fused.counts()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of one row per rule with one row per tally
    assert suite.fuse(frame.limit(0), [checks.unique("word").named(1, "a")]).counts().first()["failed"] == 0
