"""ZIP archives as a source of files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.paths import extension
from srcgraph.schemas import FILES

_MB = 1024 * 1024


def scan_zip(
    spark: SparkSession, path: str, max_compressed_mb: int = 100, max_uncompressed_mb: int = 500,
) -> DataFrame:
    """Entries of all ``*.zip`` below ``path``; the archive name is the repo.

    An archive above a limit, with an entry that leaves the root or with a broken
    directory fails the job.  Entries leave the worker in small batches.
    """
    archives = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", True).load(path)
        .select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("repo"), "length",
                "modificationTime", "content"))
    schema = "repo STRING, path STRING, size_bytes BIGINT, mtime TIMESTAMP, content STRING"
    megabyte = _MB

    # defined here so that workers need no copy of this package
    def entries(row) -> Iterator[pd.DataFrame]:
        if row.length > max_compressed_mb * megabyte:
            raise ValueError(f"archive {row.repo} is above {max_compressed_mb} MB")
        try:
            archive = zipfile.ZipFile(io.BytesIO(row.content))
        except zipfile.BadZipFile as e:
            raise ValueError(f"archive {row.repo} is not a valid ZIP") from e
        total, rows, held = 0, [], 0
        for info in archive.infolist():
            total += info.file_size
            if total > max_uncompressed_mb * megabyte:
                raise ValueError(f"archive {row.repo} expands beyond {max_uncompressed_mb} MB")
            parts = [p for p in info.filename.split("/") if p not in ("", ".")]
            if ".." in parts:
                raise ValueError(f"path leaves the archive: {info.filename}")
            if not parts or info.is_dir():
                continue
            rows.append({
                "repo": row.repo, "path": "/".join(parts), "size_bytes": info.file_size,
                "mtime": row.modificationTime,
                "content": archive.read(info).decode("utf-8", errors="replace")})
            held += info.file_size
            if held > 8 * megabyte:
                yield pd.DataFrame(rows)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield from entries(row)

    out = archives.mapInPandas(expand, schema)
    return out.select("repo", "path", extension("path").alias("ext"), "size_bytes", "mtime",
                      "content").to(FILES)
