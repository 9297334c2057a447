"""String cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_string(c: Column) -> Column:
    """Collapse any whitespace run (tabs, newlines too) to one space, trim,
    title-case; empty becomes NULL."""
    collapsed = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.nullif(F.initcap(collapsed), F.lit(""))


def truthy(c: Column) -> Column:
    """Config boolean: true/1/yes (any case, trimmed)."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")


def pipe_list(c: Column, upper: bool = True) -> Column:
    """``A|b| c`` -> array of trimmed, non-empty items (upper-cased by default)."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    items = F.filter(items, lambda x: x != F.lit(""))
    return F.transform(items, lambda x: F.upper(x)) if upper else items


def snake_case(name: str) -> str:
    """``StageName`` / ``Stage Name`` / ``STAGE-NAME`` -> ``stage_name``."""
    import re

    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"[^0-9a-zA-Z]+", "_", s).strip("_").lower()


def snake_case_columns(df):
    """Rename every column to snake_case (staging projection)."""
    return df.withColumnsRenamed({c: snake_case(c) for c in df.columns if snake_case(c) != c})
