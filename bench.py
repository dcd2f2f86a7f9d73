"""Time the headline queries over whole tables and print one JSON line.

Every query is written to Spark's ``noop`` sink, so all rows and columns are produced and
nothing travels through Python. Each number is the better of BENCH_RUNS runs.
Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_RUNS, BENCH_ALL=1.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from assayline.operators import checks  # noqa: E402
from assayline.operators.evaluate import counts  # noqa: E402
from assayline.plans import all_queries  # noqa: E402
from assayline.plans.check_plans import LINE_RULES  # noqa: E402
from assayline.session import build_session  # noqa: E402

HEADLINE = (
    "run_suite", "run_suite_wide", "run_suite_evidence", "chk_unique", "chk_unique_text", "chk_unique_composite", "xref_exists",
    "xref_exists_norm", "xref_missing", "chk_left_join", "chk_date_text", "chk_threshold", "json_field", "rule_evidence",
    "kpi_trend", "description_asof_version", "rule_latest_kpi", "rule_versions", "run_failures", "latest_failures",
    "infer_types", "cell_type_issues", "lossless_audit", "upsert_by_id", "tables_equal", "registry_diff",
    "reconcile_runs_after_delete", "tickets_replay", "tickets_apply", "run_bundle_audit", "import_new_runs", "late_runs",
    "sync_summary", "chk_unique_shuffled", "xref_exists_shuffled", "run_suite_shuffled", "run_suite_evidence_shuffled",
    "stored_run_counts", "rule_dependencies", "tickets_apply_many", "rule_counts_as_of", "snapshot_refresh",
)


def one_rule_at_a_time(spark, folder):
    """The wide suite as a loop over its rules, as an engine without fusion would run it."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("id", F.col("l_orderkey"))
    for rule, field, test in LINE_RULES:
        counts(checks.rows(lines, checks.condition(field, test))).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "assayline-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    names = sorted(known) if os.environ.get("BENCH_ALL") else HEADLINE

    def timed(action) -> float:
        best = float("inf")
        for _ in range(runs):
            started = time.perf_counter()
            action()
            best = min(best, time.perf_counter() - started)
        return round(best, 3)

    def sink(name):
        return lambda: known[name](spark, folder).write.format("noop").mode("overwrite").save()

    sink("chk_range")()
    seconds = {name: timed(sink(name)) for name in names}
    seconds["wide_suite_one_rule_at_a_time"] = timed(lambda: one_rule_at_a_time(spark, folder))
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
