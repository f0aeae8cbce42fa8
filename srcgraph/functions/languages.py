"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.paths import _col

# fixed values: extension -> display language
LANGUAGE_OF_EXT = {
    ".py": "Python", ".pyi": "Python",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript",
    ".java": "Java", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP",
    ".c": "C", ".cpp": "C++", ".cc": "C++", ".h": "C/C++", ".hpp": "C++",
    ".cs": "C#", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala",
}

# fixed values: extension -> extractor family
FAMILY_OF_EXT = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".java": "java", ".rb": "ruby",
    ".c": "cpp", ".h": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".hh": "cpp",
    ".cxx": "cpp",
    ".rs": "rust",
}

# fixed values: extractor family -> name in the list of supported languages
FAMILY_NAMES = {
    "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "go": "Go",
    "java": "Java", "ruby": "Ruby", "cpp": "C/C++", "rust": "Rust",
}


def lookup(column, mapping: dict[str, str]) -> Column:
    """Map by literal table, null when absent."""
    return F.element_at(
        F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), _col(column))


def language_of_ext(ext) -> Column:
    return lookup(ext, LANGUAGE_OF_EXT)


def family_of_ext(ext) -> Column:
    return lookup(ext, FAMILY_OF_EXT)


def detect_languages(files: DataFrame) -> DataFrame:
    """``repo, language, files`` over all files, ignored ones included."""
    return (
        files.select("repo", language_of_ext("ext").alias("language"))
        .where("language IS NOT NULL").groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("files")))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Count and percentage per language with the repo total and primary language."""
    counts = detect_languages(files)
    total = counts.groupBy("repo").agg(
        F.sum("files").alias("total_files"),
        F.min_by("language", F.struct(-F.col("files"), F.col("language")))
        .alias("primary_language"))
    return counts.join(total, "repo").select(
        "repo", "language", "files",
        F.bround(F.col("files") / F.col("total_files") * 100, 2).alias("percentage"),
        "total_files", "primary_language")


def is_multi_language(files: DataFrame, threshold: int = 10) -> DataFrame:
    """More than one language with at least ``threshold`` files."""
    counts = detect_languages(files)
    return counts.groupBy("repo").agg(
        (F.sum((F.col("files") >= threshold).cast("int")) > 1).alias("is_multi_language"))
