"""Checks of one table's columns against the keys of a reference table."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayline.errors import DataQualityError
from assayline.functions.text import column, escaped_name, normalised

ALIAS = r"[a-z][a-z0-9_]{0,63}"


@dataclass(frozen=True)
class CrossReference:
    """A record passes when its column values exist (or are missing) in the reference.

    A NULL in a tested column decides first: ``nulls='skip'`` passes, ``'fail'`` fails.
    """

    reference: str
    pairs: tuple[tuple[str, str], ...]
    key: str = "id"
    mode: str = "exists"
    nulls: str = "fail"
    normalize: bool = False
    active_column: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "pairs", tuple(tuple(pair) for pair in self.pairs))
        if not re.fullmatch(ALIAS, self.reference):
            raise DataQualityError("The alias of a reference consists of a-z, 0-9 and _.")
        if self.mode not in ("exists", "missing") or self.nulls not in ("skip", "fail"):
            raise DataQualityError("mode is exists or missing; nulls is skip or fail.")
        if not isinstance(self.normalize, bool):
            raise DataQualityError("normalize is true or false.")
        if not 1 <= len(self.pairs) <= 12 or any(len(pair) != 2 for pair in self.pairs):
            raise DataQualityError("From one to twelve pairs of columns can be compared.")
        names = [self.key, *[name for pair in self.pairs for name in pair]]
        if self.active_column is not None:
            names.append(self.active_column)
        for name in names:
            if not isinstance(name, str) or not name or min(map(ord, name)) < 32:
                raise DataQualityError("A column name is missing or holds control characters.")
        if self.pairs[0][0] in ("id", "dq_check"):
            raise DataQualityError("The column under test cannot be id or dq_check.")

    @classmethod
    def from_dict(cls, data: dict) -> CrossReference:
        wanted = {"reference", "key", "pairs", "mode", "nulls", "normalize", "active_column"}
        if not isinstance(data, dict) or set(data) != wanted:
            raise DataQualityError("These settings do not describe a cross-table check.")
        return cls(**data)

    def to_dict(self) -> dict:
        return {**asdict(self), "pairs": [list(pair) for pair in self.pairs]}

    @property
    def field(self) -> str:
        return self.pairs[0][0]

    def _comparable(self, value: Column) -> Column:
        return normalised(value) if self.normalize else value

    def any_null(self) -> Column:
        found = F.lit(False)
        for tested, _ in self.pairs:
            found = found | column(tested).isNull()
        return found

    def row_keys(self) -> list[Column]:
        return [self._comparable(column(tested)) for tested, _ in self.pairs]

    def reference_keys(self, reference: DataFrame, names: list[str], hit: str) -> DataFrame:
        """Distinct comparable keys of the reference, one row per key, with a hit marker."""
        if self.active_column is not None:
            active = column(self.active_column)
            if not isinstance(reference.schema[self.active_column].dataType, T.BooleanType):
                active = active.cast("boolean")
            reference = reference.where(active)
        keys = [
            self._comparable(column(other)).alias(name)
            for (_, other), name in zip(self.pairs, names)
        ]
        return reference.select(*keys).dropna().distinct().withColumn(hit, F.lit(True))

    def passes(self, hit: Column) -> Column:
        found = F.coalesce(hit, F.lit(False))
        verdict = found if self.mode == "exists" else ~found
        return F.when(self.any_null(), F.lit(self.nulls == "skip")).otherwise(verdict)

    def sql(self, source: str = "source") -> str:
        """The same check as rule text over the views ``source`` and the reference alias."""
        def side(alias: str, name: str) -> str:
            value = f"{alias}.{escaped_name(name)}"
            return f"upper(trim({value}))" if self.normalize else value

        keys = ", ".join(
            f"{side('found', other)} AS k{i}" for i, (_, other) in enumerate(self.pairs)
        )
        active = (
            "" if self.active_column is None
            else f" WHERE cast(found.{escaped_name(self.active_column)} AS boolean)"
        )
        matched = " AND ".join(
            f"known.k{i} = {side('tested', mine)}" for i, (mine, _) in enumerate(self.pairs)
        )
        missing = " OR ".join(f"tested.{escaped_name(mine)} IS NULL" for mine, _ in self.pairs)
        hit, miss = (0, 1) if self.mode == "exists" else (1, 0)
        field = escaped_name(self.field)
        return (
            f"SELECT tested.{escaped_name(self.key)} AS id, tested.{field} AS {field},\n"
            f"  CASE WHEN {missing} THEN {0 if self.nulls == 'skip' else 1}\n"
            f"    WHEN known.k0 IS NOT NULL THEN {hit} ELSE {miss} END AS dq_check\n"
            f"FROM {source} tested\n"
            f"LEFT JOIN (SELECT DISTINCT {keys} FROM {self.reference} found{active}) known\n"
            f"  ON {matched}"
        )
