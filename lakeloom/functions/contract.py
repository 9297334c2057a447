"""Key promotion and contract validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: reason text prefix of a contract failure.
MISSING_PREFIX = "missing/null required field(s): "
INVALID_TS_REASON = "invalid event_timestamp"


def _path(key: str) -> str:
    return "$." + key if key.replace("_", "").isalnum() else "$['" + key.replace("'", "\\'") + "']"


def payload_field(payload: Column, path: str, type_: str = "string") -> Column:
    """Typed value at a payload path; missing path, JSON null or a type
    mismatch give NULL (never an error)."""
    return F.try_variant_get(payload, path, type_)


def promoted(payload: Column, key: str) -> Column:
    """Best-effort top-level key as text (numbers and objects render as JSON text)."""
    return payload_field(payload, _path(key), "string")


def missing_keys(values: dict[str, Column], required: tuple[str, ...]) -> Column:
    """array<string> of the required keys whose promoted value is missing, JSON null
    or "", in contract order. Whitespace, 0 and false pass."""
    checks = []
    for key in required:
        v = values[key]
        checks.append(F.when(v.isNull() | (v == F.lit("")), F.lit(key)))
    return F.array_compact(F.array(*checks))


def invalid_timestamp(payload: Column, key: str) -> Column:
    """True when the timestamp text is present but does not parse."""
    return unparsable(promoted(payload, key))


def unparsable(v: Column) -> Column:
    """The same of a promoted value."""
    return v.isNotNull() & (v != F.lit("")) & v.try_cast("timestamp_ntz").isNull()


def contract_reason(values: dict[str, Column], required: tuple[str, ...], timestamp_key: str | None) -> Column:
    """Quarantine reason, or NULL for a valid record. ``values``: the promoted value of
    each key, a column of its own, as it is used several times."""
    miss = missing_keys(values, required)
    missing_text = F.when(F.size(miss) > 0, F.concat(F.lit(MISSING_PREFIX), F.array_join(miss, ", ")))
    parts = [missing_text]
    if timestamp_key:
        parts.append(F.when(unparsable(values[timestamp_key]), F.lit(INVALID_TS_REASON)))
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))
