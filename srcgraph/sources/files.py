"""Source-tree scan: files to the ``files`` table, ignore globs, line reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.paths import extension
from srcgraph.operators.extract import supported_extensions

# fixed values: globs that are never scanned
DEFAULT_IGNORE = [
    ".venv", "venv", ".dev", ".master", "env", ".env", "__pycache__", ".git", "node_modules",
    "*.pyc", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".nox", ".idea", ".vscode",
    "dist", "build", "*.egg-info", "*.egg", "*.dist-info", "site-packages", ".eggs", ".next",
    ".nuxt", "target", "vendor", ".cache", "htmlcov", ".coverage", ".hypothesis",
]

# fixed values: limits of the pattern guard
MAX_PATTERNS = 100
MAX_PATTERN_LENGTH = 200
MAX_REPETITIONS = 3
DANGEROUS = [r"\(.*\)\*", r"\(.*\)\+", r"\(.*\)\{", r"(\.\*){2,}"]


def validate_globs(patterns: list[str] | None) -> list[str]:
    """Trimmed, non-blank patterns; raises ``ValueError`` on an unsafe one."""
    if not patterns:
        return []
    if not isinstance(patterns, list):
        raise ValueError("ignore patterns must be a list")
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} ignore patterns")
    kept = []
    for pattern in patterns:
        if not isinstance(pattern, str):
            raise ValueError("an ignore pattern must be a string")
        pattern = pattern.strip()
        if not pattern:
            continue
        if len(pattern) > MAX_PATTERN_LENGTH:
            raise ValueError("ignore pattern too long")
        if re.search(r"[*+{}]{%d,}" % (MAX_REPETITIONS + 1), pattern):
            raise ValueError("too many repetition characters in a row")
        if any(re.search(d, pattern) for d in DANGEROUS):
            raise ValueError("unsafe construct in ignore pattern")
        kept.append(pattern)
    return kept


def _glob_regex(glob: str) -> str:
    """One glob as a Java regex for a whole path segment."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c)
        i += 1
    return out


def ignore_regex(patterns: list[str] | None = None) -> str:
    """Anchored alternation of the default and the given globs."""
    merged = list(dict.fromkeys(DEFAULT_IGNORE + validate_globs(patterns)))
    return r"(^|/)(" + "|".join(_glob_regex(p) for p in merged) + r")(/|$)"


def is_ignored(path, patterns: list[str] | None = None) -> Column:
    """Whether any segment below the root matches an ignore glob."""
    rx = r"^(" + ignore_regex(patterns)[len(r"(^|/)("):-len(r")(/|$)")] + r")$"
    path = F.col(path) if isinstance(path, str) else path
    return F.exists(F.split(path, "/"), lambda s: s.rlike(rx))


def filter_ignored(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return files.where(~is_ignored("path", patterns))


def scan_files(
    spark: SparkSession, root: str, repo: str | None = None, patterns: list[str] | None = None,
    all_files: bool = False,
) -> DataFrame:
    """Files below ``root`` as the ``files`` table.

    Without ``repo`` the first folder below the root names the repository, so a
    folder of checkouts becomes a portfolio.  Only supported extensions are read,
    plus project configs; ``all_files`` keeps everything but the ignored ones.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not all_files:  # at the listing, so that other files are never opened
        wanted = [f"*{e}" for e in supported_extensions()] + CONFIG_FILES
        reader = reader.option("pathGlobFilter", "{" + ",".join(wanted) + "}")
    raw = (
        reader.load(root)
        .select("path", "modificationTime", "length", "content"))
    base = re.sub(r"^[a-z]+:/*", "", root).strip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""),
                           "^" + re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", base) + "/", "")
    if repo is None:
        key, path = F.substring_index(rel, "/", 1), F.regexp_replace(rel, r"^[^/]*/", "")
    else:
        key, path = F.lit(repo), rel
    rows = raw.select(
        key.alias("repo"), path.alias("path"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"), F.col("content").alias("raw"))
    rows = rows.where(~is_ignored("path", patterns)).withColumn("ext", extension("path"))
    if not all_files:
        configs = F.regexp_extract("path", r"([^/]+)$", 1).isin(CONFIG_FILES)
        rows = rows.where(F.col("ext").isin(supported_extensions()) | configs)
    return rows.select("repo", "path", "ext", "size_bytes", "mtime",
                       F.col("raw").cast("string").alias("content"))


# fixed values: project files that steer resolution
CONFIG_FILES = ["go.mod", "tsconfig.json", "jsconfig.json", "pom.xml", "build.gradle",
                "build.gradle.kts"]
