"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(path) -> Column:
    """Backslashes to slashes, runs of slashes collapsed."""
    return F.regexp_replace(_col(path), r"[\\/]+", "/")


def strip_leading(path) -> Column:
    return F.regexp_replace(_col(path), r"^/+", "")


def relative_path(path, project) -> Column:
    """Path below the project folder; the prefix test ignores case."""
    p = normalize_path(path)
    base = F.regexp_replace(normalize_path(project), r"/$", "")
    inside = F.lower(p).startswith(F.concat(F.lower(base), F.lit("/")))
    tail = F.substring(p, F.length(base) + 2, F.length(p))
    return strip_leading(
        F.when((base != "") & inside & (tail != ""), tail).otherwise(p))


def is_under_folder(relative, folder) -> Column:
    """The folder itself or anything below it."""
    norm = strip_leading(normalize_path(relative))
    base = strip_leading(normalize_path(folder))
    return (norm == base) | norm.startswith(F.concat(base, F.lit("/")))


def folder_path(relative) -> Column:
    """Directory part, empty at the root."""
    norm = F.regexp_replace(F.regexp_replace(_col(relative), r"\\", "/"), r"/+$", "")
    return F.regexp_extract(norm, r"^(.*)/[^/]*$", 1)


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path) -> Column:
    """Suffix of the last segment with its dot, empty when there is none."""
    return F.regexp_extract(_col(path), r"[^/](\.[^./]+)$", 1)


def drop_extension(path) -> Column:
    """The path without the suffix of its last segment."""
    return F.regexp_replace(_col(path), r"(?<=[^/])\.[^./]+$", "")


def normalize_file_key(path) -> Column:
    """Key form: slashes only, no leading separator, no empty or dot segments."""
    p = F.regexp_replace(_col(path), r"\\", "/")
    p = F.regexp_replace(p, r"/(\./)+", "/")
    p = F.regexp_replace(p, r"/+", "/")
    return F.regexp_replace(p, r"^/|^(\./)+|/\.?$", "")


OUTSIDE = "\x00outside"


def resolve_dots(path) -> Column:
    """Fold ``.`` and ``..``; null when the path leaves the project root."""
    parts = F.split(_col(path), "/")

    def push(acc: Column, seg: Column) -> Column:
        popped = F.when(F.size(acc) == 0, F.array(F.lit(OUTSIDE))).otherwise(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return (
            F.when(F.array_contains(acc, OUTSIDE) | (seg == "") | (seg == "."), acc)
            .when(seg == "..", popped)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    folded = F.aggregate(parts, F.array().cast("array<string>"), push)
    plain = F.regexp_replace(F.regexp_replace(_col(path), r"^/+", ""), r"/+", "/")
    needs = _col(path).rlike(r"(^|/)\.{1,2}(/|$)")
    return F.when(~needs, F.regexp_replace(plain, r"/$", "")).when(
        F.array_contains(folded, OUTSIDE), F.lit(None)).otherwise(F.array_join(folded, "/"))


def join_path(folder, name) -> Column:
    """folder/name, just the name at the root."""
    f, n = _col(folder), _col(name)
    return F.when(f == "", n).otherwise(F.concat(f, F.lit("/"), n))


def path_prefixes(path) -> Column:
    """All prefixes of a path, shortest first, the path itself last."""
    p = _col(path)
    return F.transform(
        F.sequence(F.lit(1), F.size(F.split(p, "/"))),
        lambda i: F.call_function("substring_index", p, F.lit("/"), i))
