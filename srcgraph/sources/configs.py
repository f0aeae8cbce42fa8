"""Project configuration files that steer import resolution, one row per repo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.paths import folder_path, path_prefixes, resolve_dots

ALIASES = "array<struct<alias:string,target:string>>"


def read_go_mod(files: DataFrame) -> DataFrame:
    """``repo, go_module`` from the first ``module`` line of the root go.mod."""
    found = files.where("path = 'go.mod'").select(
        "repo", F.trim(F.regexp_extract("content", r"(?m)^[ \t]*module[ \t]+(\S.*)$", 1))
        .alias("go_module"))
    return found.where("go_module <> ''")


def read_js_aliases(files: DataFrame) -> DataFrame:
    """``repo, aliases`` from compilerOptions; tsconfig wins over jsconfig."""
    schema = "compilerOptions STRUCT<baseUrl: STRING, paths: MAP<STRING, ARRAY<STRING>>>"
    docs = files.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select(
        "repo", "path", F.from_json("content", schema).alias("c")).where("c IS NOT NULL")
    # of the valid documents of a repo, tsconfig sorts last and wins
    best = docs.groupBy("repo").agg(F.max_by("c", "path").alias("c"))
    entry = lambda e: F.struct(
        F.regexp_replace(e["key"], r"\*+$", "").alias("alias"),
        resolve_dots(F.concat_ws("/", F.coalesce(F.col("c.compilerOptions.baseUrl"), F.lit(".")),
                                 F.regexp_replace(e["value"][0], r"[/*]+$", ""))).alias("target"))
    listed = F.transform(
        F.filter(F.map_entries("c.compilerOptions.paths"), lambda e: F.size(e["value"]) > 0), entry)
    return best.select("repo", F.coalesce(listed, F.array().cast(ALIASES)).alias("aliases"))


def read_java_roots(files: DataFrame) -> DataFrame:
    """``repo, java_roots``: existing source roots in lookup order, '' is the root."""
    declared = (
        files.where("path = 'pom.xml'").select("repo", F.lit(0).alias("doc"), F.regexp_extract_all(
            "content", F.lit(r"<sourceDirectory>\s*([^<]+?)\s*</sourceDirectory>"), F.lit(1))
            .alias("dirs"))
        .unionByName(
            files.where(F.col("path").isin("build.gradle", "build.gradle.kts")).select(
                "repo", F.when(F.col("path") == "build.gradle", 1).otherwise(2).alias("doc"),
                F.flatten(F.transform(
                    F.regexp_extract_all(
                        "content", F.lit(r"java\s*\{\s*srcDirs\s*=\s*\[\s*([^\]]+)\]\s*\}"), F.lit(1)),
                    lambda m: F.regexp_extract_all(m, F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))))
                .alias("dirs"))))
    built = F.array(F.lit("src/main/java"), F.lit("src/test/java"))
    plain = F.array(F.lit("src/main/java"), F.lit("src/java"), F.lit("src"), F.lit(""))
    wanted = declared.select("repo", "doc", F.posexplode(F.concat(
        F.transform("dirs", lambda d: F.struct(F.lit(0).alias("level"), resolve_dots(d).alias("d"))),
        F.transform(built, lambda d: F.struct(F.lit(1).alias("level"), d.alias("d")))))
        .alias("i", "x")).select("repo", "doc", "i", "x.level", "x.d")
    # existing folders: prefixes of the folders of Java files (a root without them resolves nothing)
    here = files.where("ext = '.java'").select("repo", folder_path("path").alias("f")).distinct()
    dirs = here.select("repo", F.explode(F.concat(
        F.array(F.lit("")), path_prefixes("f"))).alias("d")).distinct()
    live = wanted.join(dirs, ["repo", "d"], "left_semi")
    # the defaults of a build file count only when none of its declared folders exists
    lead = live.groupBy("repo", "doc").agg(F.min("level").alias("level"))
    live = live.join(lead, ["repo", "doc", "level"]).select("repo", "doc", "i", "d")
    # without roots from build files the plain places are tried
    rest = here.select("repo").distinct().join(live.select("repo").distinct(), "repo", "left_anti")
    fallback = rest.select("repo", F.lit(9).alias("doc"), F.posexplode(plain).alias("i", "d")).join(
        dirs, ["repo", "d"], "left_semi").select("repo", "doc", "i", "d")
    first = live.unionByName(fallback).groupBy("repo", "d").agg(
        F.min(F.struct("doc", "i")).alias("o"))
    return first.groupBy("repo").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]).alias("java_roots"))


def project_configs(files: DataFrame) -> DataFrame:
    """``repo, go_module, aliases, java_roots`` for ``resolve_imports``."""
    return (
        files.select("repo").distinct().join(read_go_mod(files), "repo", "left")
        .join(read_js_aliases(files), "repo", "left").join(read_java_roots(files), "repo", "left"))
