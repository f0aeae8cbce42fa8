"""Table schemas.  ``repo`` is the portfolio key; every operator groups by it."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
    "ARRAY<INT>": T.ArrayType(T.IntegerType()), "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """A struct from ``name TYPE, ...`` without a running session."""
    pairs = [field.split(" ") for field in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FILES_DDL = (
    "repo STRING, path STRING, ext STRING, size_bytes BIGINT, mtime TIMESTAMP, content STRING"
)
IMPORTS_DDL = (
    "repo STRING, source_file STRING, imported_module STRING, import_type STRING, "
    "line_number INT, pos INT"
)
NODES_DDL = (
    "repo STRING, id STRING, label STRING, file_path STRING, node_type STRING, "
    "external_kind STRING, version STRING, import_count BIGINT, imported_by_count BIGINT, "
    "pagerank DOUBLE, betweenness DOUBLE, cycle_count BIGINT, instability DOUBLE, depth INT, "
    "closeness DOUBLE, eigenvector DOUBLE, external_ratio DOUBLE, size_bytes BIGINT, "
    "line_count BIGINT, commit_hash STRING"
)
EDGES_DDL = (
    "repo STRING, source STRING, target STRING, import_type STRING, line_numbers ARRAY<INT>"
)
COMMITS_DDL = (
    "repo STRING, path STRING, hash STRING, subject STRING, author_name STRING, "
    "author_email STRING, ts TIMESTAMP"
)
AUDIT_DDL = (
    "timestamp TIMESTAMP, request_id STRING, action STRING, level STRING, username STRING, "
    "user_roles ARRAY<STRING>, ip_address STRING, resource STRING, details MAP<STRING,STRING>, "
    "success BOOLEAN, error_message STRING"
)
SAMPLES_DDL = "ts TIMESTAMP, metric STRING, labels MAP<STRING,STRING>, value DOUBLE"
PROGRESS_DDL = "ts TIMESTAMP, analysis_id STRING, status STRING, progress INT"

FILES = _struct(FILES_DDL)
IMPORTS = _struct(IMPORTS_DDL)
NODES = _struct(NODES_DDL)
EDGES = _struct(EDGES_DDL)
COMMITS = _struct(COMMITS_DDL)
AUDIT = _struct(AUDIT_DDL)
SAMPLES = _struct(SAMPLES_DDL)
PROGRESS = _struct(PROGRESS_DDL)
