"""Schemas of the graph and reading of JSON properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_SCHEMA = "id long, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string"
EDGE_SCHEMA = "id long, project string, source_id long, target_id long, type string, properties string"
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
EDGE_COLUMNS = [c.split()[0] for c in EDGE_SCHEMA.split(", ")]
FILE_HASH_SCHEMA = "project string, rel_path string, sha256 string, mtime_ns long, size long"
COVERAGE_SCHEMA = "rel_path string, kind string, detail string"
SPAN_SCHEMA = "kind int, attributes map<string,string>, start_time string, end_time string"
COMMIT_SCHEMA = "commit_id string, ts long, file string"
HUNK_SCHEMA = "path string, start_line int, end_line int"

#: Families of labels.
TYPE_LABELS = ["Class", "Struct", "Interface", "Enum", "Type", "Trait"]
CALLABLE_LABELS = ["Function", "Method"]
RELATION_LABELS = ["Table", "View", "Model"]


def prop(key: str, column: str | Column = "properties") -> Column:
    """A property as text; NULL where it is missing or the text is no JSON."""
    return F.get_json_object(F.col(column) if isinstance(column, str) else column, f"$.{key}")


def flag(key: str, column: str | Column = "properties") -> Column:
    """Truth of a property in any of its forms: true, 1 or "1"."""
    return F.coalesce(F.lower(prop(key, column)).isin("true", "1"), F.lit(False))


def keys(column: str | Column = "properties") -> Column:
    """Names of the properties; NULL where the text is no JSON object."""
    return F.json_object_keys(F.col(column) if isinstance(column, str) else column)
