"""Column functions (all built-in Spark expressions, no Python UDFs)."""

from lakeloom.functions.paths import file_hour, path_dt, path_hr, relative_path
from lakeloom.functions.contract import contract_reason, promoted, payload_field
from lakeloom.functions.text import clean_string

__all__ = [
    "file_hour", "path_dt", "path_hr", "relative_path",
    "contract_reason", "promoted", "payload_field", "clean_string",
]
