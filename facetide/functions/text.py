"""Text rules: label case, KPI formatting, label-file lines, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
KPI_MISSING = "—"
BLANK = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"  # characters trimmed from label lines
BYTE_ORDER_MARK = "\ufeff"


def fold_case(label: Column) -> Column:
    return F.lower(label)


def kpi_text(value: Column, decimals: int = 0) -> Column:
    """Half-even rounded text of a KPI; null and NaN show as a dash."""
    rounded = F.bround(value, decimals)
    shown = rounded.cast("bigint").cast("string") if decimals == 0 else F.format_string(f"%.{decimals}f", rounded)
    return F.when(value.isNull() | F.isnan(value), F.lit(KPI_MISSING)).otherwise(shown)


def parse_json(payload: Column, schema: T.StructType | str) -> Column:
    """Struct from JSON bytes or text; malformed input gives null fields, never an error."""
    return F.from_json(payload.cast("string"), schema, {"mode": "PERMISSIVE"})


def label_lines(text: Column) -> Column:
    """Lines of a label file: trimmed, blanks and a leading byte-order mark removed."""
    body = F.regexp_replace(text, f"^{BYTE_ORDER_MARK}", "")
    edges = rf"\A{BLANK}+|{BLANK}+\z"
    lines = F.transform(F.split(body, r"\r\n|\r|\n"), lambda line: F.regexp_replace(line, edges, ""))
    return F.filter(lines, lambda line: line != "")
