"""Canonical rule payloads and their revision hash."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, functions as F

from assayline.errors import DataQualityError

# Fields of a rule payload, by contract number.
BASE_FIELDS = frozenset(
    {
        "contract", "rule_key", "local_version", "description", "rule_type",
        "severity", "error_message", "active", "source", "sql",
    }
)
EXTRA_FIELDS = {1: frozenset(), 2: frozenset({"cross_spec", "references"}), 3: frozenset({"references"})}
SEVERITIES = ("low", "medium", "high")
RULE_KEY = r"[a-z0-9][a-z0-9_-]{0,79}"


def canonical(payload: object) -> str:
    """Compact JSON with sorted keys and unescaped letters."""
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def revision(payload: object) -> str:
    return hashlib.sha256(canonical(payload).encode("utf-8")).hexdigest()


def canonical_column(**fields: Column) -> Column:
    """The same canonical text built from columns (NULL fields are kept as null)."""
    members = [fields[key].alias(key) for key in sorted(fields)]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def parsed_column(payload: Column) -> Column:
    """JSON text as a value; NULL where it is no JSON or names a key twice."""
    return F.try_parse_json(payload)


def normal_column(value: Column) -> Column:
    """The canonical text of a parsed payload: compact, keys sorted, letters unescaped - however it was written."""
    return F.to_json(value)


def revision_column(payload: Column) -> Column:
    """Revision of a payload, whatever its spacing, order of keys and escapes."""
    return F.sha2(normal_column(parsed_column(payload)), 256)


def _dataset(parts: object) -> bool:
    return (
        isinstance(parts, list)
        and len(parts) == 3
        and all(isinstance(p, str) and p and min(map(ord, p)) >= 32 for p in parts)
    )


def check_payload(payload: dict) -> dict:
    """Refuse a rule payload that does not follow its contract."""
    contract = payload.get("contract")
    if contract not in EXTRA_FIELDS or set(payload) != BASE_FIELDS | EXTRA_FIELDS[contract]:
        raise DataQualityError("The payload has other fields than its contract.")
    texts = ("local_version", "description", "rule_type", "error_message", "sql", "rule_key")
    if not all(isinstance(payload[name], str) for name in texts):
        raise DataQualityError("A text field of the payload holds something else.")
    if not re.fullmatch(RULE_KEY, payload["rule_key"]):
        raise DataQualityError("The rule key is malformed.")
    if payload["severity"] not in SEVERITIES or not isinstance(payload["active"], bool):
        raise DataQualityError("Severity or active flag has no known value.")
    if not _dataset(payload["source"]):
        raise DataQualityError("Give the source as catalog, schema and table.")
    references = payload.get("references", {})
    if not isinstance(references, dict) or not all(map(_dataset, references.values())):
        raise DataQualityError("Give each reference as catalog, schema and table.")
    if contract == 2:
        from assayline.operators.crossref import CrossReference

        spec = CrossReference.from_dict(payload["cross_spec"])
        if set(references) != {spec.reference}:
            raise DataQualityError("The rule compares with another reference than is mapped.")
    return payload


def revision_of_text(payload: str) -> str:
    """Revision of a payload already stored as text, whatever its spacing."""
    return revision(json.loads(payload))
