"""Repository URLs and content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.paths import _col

# fixed values: prefixes of derived ids
REPO_ID_PREFIX = "repo_"
PROJECT_ID_PREFIX = "local-project-"


def _parts(url) -> tuple[Column, Column, Column]:
    u = _col(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return scheme, host, path


def normalize_repo_url(url) -> Column:
    """Trim, drop ``.git`` and trailing slashes, lower-case host, no query or fragment."""
    u = F.regexp_replace(F.trim(_col(url)), r"\.git$", "")
    u = F.regexp_replace(u, r"/+$", "")
    scheme, host, path = _parts(u)
    path = F.regexp_replace(path, r"/+$", "")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path))


def valid_repo_url(url, allowed_hosts: list[str] | None = None) -> Column:
    """https only, host and path present, host (without port) on the allow-list."""
    u = F.trim(_col(url))
    _, host, path = _parts(u)
    ok = u.startswith("https://") & (host != "") & (path != "") & (path != "/")
    if allowed_hosts:
        bare = F.split_part(host, F.lit(":"), F.lit(1))
        ok = ok & bare.isin([h.lower() for h in allowed_hosts])
    return F.coalesce(ok, F.lit(False))


def repo_cache_id(url, ref=None) -> Column:
    """Stable id of (normalised URL, ref); no ref means the default branch."""
    branch = F.lit("default") if ref is None else F.trim(
        F.coalesce(F.nullif(_col(ref), F.lit("")), F.lit("default")))
    raw = F.concat(normalize_repo_url(url), F.lit(":"), branch)
    return F.concat(F.lit(REPO_ID_PREFIX), F.substring(F.sha2(raw, 256), 1, 24))


def project_fingerprint(files: DataFrame, buckets: int = 4096) -> DataFrame:
    """``repo, fingerprint``: changes when a path or an mtime of the repo changes.

    Two levels of SHA-256: the sorted ``path:mtime`` entries of each of a fixed
    number of hash buckets, then the bucket digests in bucket order.  A repo of
    any size therefore never has to fit one task.
    """
    entry = F.concat(F.col("path"), F.lit(":"), F.unix_micros("mtime").cast("string"))
    bucket = F.pmod(F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    leaves = files.groupBy("repo", bucket.alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ""), 256).alias("digest"))
    return leaves.groupBy("repo").agg(
        F.concat(
            F.lit(PROJECT_ID_PREFIX),
            F.substring(F.sha2(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("bucket", "digest"))),
                lambda x: x["digest"]), ""), 256), 1, 16),
        ).alias("fingerprint"))
