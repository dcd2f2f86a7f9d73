"""Which columns rules depend on, through any views between, and what those columns hold.

Dependencies come from analysed plans, so aliases, stars, joins and subqueries are resolved by Spark. A rule that reads a
view depends on everything the view's text reads: its filters and joins decide the rule's records as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayline.errors import DataQualityError
from assayline.functions.text import column
from assayline.operators.evaluate import analyse, select

DEPENDENCY = "rule_id string, dataset string, column_name string, via string"


def dependencies(
    spark: SparkSession, rules: Mapping[str, str], datasets: Mapping[str, DataFrame], views: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per rule, dataset and column; ``via`` is the view the rule names, empty where it names the dataset.

    ``views`` are named texts over the datasets and over each other. A ring of views is an error.
    """
    views = dict(views or {})
    frames: dict[str, DataFrame] = dict(datasets)
    below: dict[str, dict[str, set[str]]] = {}

    def resolve(name: str, path: tuple[str, ...] = ()) -> None:
        if name in frames:
            return
        if name in path:
            raise DataQualityError(f"Views refer to each other in a ring: {' -> '.join((*path, name))}")
        for other in views:
            # Only texts that mention a name can read it; the plan decides below.
            if other != name and other.lower() in views[name].lower():
                resolve(other, (*path, name))
        _, facts = analyse(spark, views[name], frames)
        below[name] = _grounded(facts.columns, below)
        frames[name] = select(spark, views[name], {key: frames[key] for key in facts.datasets})

    for name in views:
        resolve(name)
    rows = []
    for rule_id, text in rules.items():
        _, facts = analyse(spark, text, frames)
        for name, columns in facts.columns.items():
            found = below[name] if name in below else {name: columns}
            rows += [(str(rule_id), dataset, column_, name if name in below else "") for dataset, names in found.items() for column_ in names]
    return spark.createDataFrame(sorted(set(rows)), DEPENDENCY)


def _grounded(columns: Mapping[str, Iterable[str]], below: Mapping[str, Mapping[str, set[str]]]) -> dict[str, set[str]]:
    """Columns read, with views replaced by what they read."""
    found: dict[str, set[str]] = {}
    for name, read in columns.items():
        for dataset, names in (below[name] if name in below else {name: set(read)}).items():
            found.setdefault(dataset, set()).update(names)
    return found


def column_facts(datasets: Mapping[str, DataFrame], wanted: Mapping[str, Iterable[str]]) -> DataFrame:
    """dataset, column_name, records and missing of the wanted columns: one aggregate per dataset."""
    parts = []
    for name, columns in wanted.items():
        columns = sorted(columns)
        once = datasets[name].agg(
            F.count(F.lit(1)).alias("_n"), *[F.count_if(column(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)])
        lines = [F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("missing")) for i, c in enumerate(columns)]
        parts.append(once.select(F.lit(name).alias("dataset"), F.col("_n").alias("records"), F.inline(F.array(*lines))))
    return reduce(DataFrame.unionByName, parts)


def impact(
    spark: SparkSession, rules: Mapping[str, str], datasets: Mapping[str, DataFrame], views: Mapping[str, str] | None = None
) -> DataFrame:
    """Dependencies with the records and missing values of each column: what an edit of the column would touch."""
    known = dependencies(spark, rules, datasets, views)
    wanted: dict[str, set[str]] = {}
    for row in known.select("dataset", "column_name").distinct().collect():  # rules and columns, not records
        wanted.setdefault(row["dataset"], set()).add(row["column_name"])
    if not wanted:
        return known.select("*", F.lit(0).cast("long").alias("records"), F.lit(0).cast("long").alias("missing"))
    return known.join(column_facts(datasets, wanted), ["dataset", "column_name"]).select(*known.columns, "records", "missing")
