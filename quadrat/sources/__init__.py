"""Sources and sinks.  Schemas are always given, never inferred."""

from .files import NamedFiles, found, scratch
from .results import RESULTS, read_result, write_result
from .tabular import FIELDS, bad_pages, bad_rows, csv_marked, csv_rows, existing, good_rows, json_pages, metadata_schema, month_range, reading_order, tagged_union, unnest, write_csv

__all__ = [
    "FIELDS", "NamedFiles", "RESULTS", "bad_pages", "bad_rows", "csv_marked", "csv_rows", "existing", "found", "good_rows", "json_pages", "metadata_schema", "month_range", "read_result",
    "reading_order", "scratch", "tagged_union", "unnest", "write_csv", "write_result",
]
