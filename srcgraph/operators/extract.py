"""Import extraction: one column expression per language over the file text.

Every extractor maps ``content`` to ``ARRAY<STRUCT<module, type, line>>``, so all
languages run in one pass over the ``files`` table and ``explode`` emits the
rows.  Only the exact Python mode uses a Python worker (it needs ``ast``).
"""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.languages import FAMILY_OF_EXT

ROWS = "array<struct<module:string,type:string,line:int>>"
Extractor = Callable[[Column], Column]

# fixed values: statement patterns per language, group 1 is the module
PY_IMPORT = r"^\s*import\s+(.+)$"
PY_FROM = r"^\s*from\s+(\.*[a-zA-Z0-9_.]*)\s+import\s+"
JS_ES6 = [
    r"""import\s+\w+\s+from\s+['"]([^'"]+)['"]""",
    r"""import\s+\*\s+as\s+\w+\s+from\s+['"]([^'"]+)['"]""",
    r"""import\s+\{[^}]+\}\s+from\s+['"]([^'"]+)['"]""",
    r"""import\s+\{[^}]+as\s+[^}]+\}\s+from\s+['"]([^'"]+)['"]""",
    r"""import\s+\w+\s*,\s*\{[^}]+\}\s+from\s+['"]([^'"]+)['"]""",
    r"""import\s+['"]([^'"]+)['"]""",
]
JS_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
JS_DYNAMIC = r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)"""
TS_TYPE = r"""import\s+type\s+\{[^}]+\}\s+from\s+['"]([^'"]+)['"]"""
GO_SINGLE = r'^import\s+(?:(?:\w+|_|\.)\s+)?"([^"]+)"'
GO_BLOCK = r"import\s*\([\s\S]*?\)"
GO_ITEM = r'^\s*(?:(?:\w+|_|\.)\s+)?"([^"]+)"'
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([a-zA-Z0-9_.]+(?:\.\*)?)\s*;"
RUBY = [
    (r"""require\s*\(?\s*['"]([^'"]+)['"]""", "require"),
    (r"""require_relative\s*\(?\s*['"]([^'"]+)['"]""", "require_relative"),
    (r"""load\s*\(?\s*['"]([^'"]+)['"]""", "load"),
]
CPP = [
    (r'#\s*include\s*"([^"]+)"', "local"),
    (r"#\s*include\s*<([^>]+)>", "system"),
]
RUST = [
    (r"mod\s+([a-zA-Z0-9_]+)\s*;", "mod"),
    (r"use\s+([a-zA-Z0-9_:]+)", "use"),
    (r"extern\s+crate\s+([a-zA-Z0-9_]+)\s*;", "extern_crate"),
]

# statement forms of exact JavaScript mode, tried on text without comments
_WORD_START = r"(?<![\w$.])"
JS_EXACT = [
    (_WORD_START + r"""import\s*(?:[\w$*{}\s,]+?\bfrom\s*|[\w$*{}\s,]*?\}\s*from\s*)?['"]([^'"\n]+)['"]""",
     "module"),
    (_WORD_START + r"""import\s*\(\s*['"]([^'"\n]+)['"]""", "dynamic"),
    (_WORD_START + r"""require\s*\(\s*['"]([^'"\n]+)['"]""", "require"),
    (_WORD_START + r"""export\s+(?:type\s+)?\{[^}]*\}\s*from\s*['"]([^'"\n]+)['"]""", "export-from"),
    (_WORD_START + r"""export\s+\*\s*(?:as\s+[\w$]+\s+)?from\s*['"]([^'"\n]+)['"]""", "export-all"),
]


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _hits(text: Column, pattern: str, kind: str, line: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda m: F.struct(m.alias("module"), F.lit(kind).alias("type"),
                           line.cast("int").alias("line")))


def _by_line(content: Column, keyword: str, per_line: Callable[[Column, Column], Column]) -> Column:
    """Apply ``per_line(text, line_number)`` to the lines that hold a keyword."""
    lines = F.transform(
        F.split(content, "\n"), lambda t, i: F.struct(t.alias("t"), (i + 1).alias("n")))
    kept = F.filter(lines, lambda x: x["t"].rlike(keyword))
    return F.flatten(F.transform(kept, lambda x: per_line(x["t"], x["n"])))


def _none() -> Column:
    return F.array().cast(ROWS)


def match_lines(content: Column, pattern: str) -> Column:
    """All matches of a multi-line pattern with the line each starts on.

    A mark is set before each match; a line number then counts once for every mark
    of its line, so the work grows with the text and not with the square of the matches.
    """
    mark, other = "\x01", "\x02"
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    marked = F.regexp_replace(F.translate(content, mark, other), pattern, f"{mark}$0")
    marks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
    starts = F.flatten(F.transform(
        F.split(marked, "\n"), lambda t, i: F.array_repeat(i + 1, marks(t))))
    return F.when(content.rlike(pattern), F.zip_with(
        found, starts, lambda m, n: F.struct(m.alias("m"), n.cast("int").alias("line")))).otherwise(
        F.array().cast("array<struct<m:string,line:int>>"))


def strip_comments(content: Column, mask_strings: bool = False) -> Column:
    """Blank ``//`` and ``/* */`` outside literals; newlines stay.

    With ``mask_strings`` literals that hold blanks (never a module name) are
    blanked too, and back-tick literals count as literals.
    """
    tick = r"|`(?:\\.|[^`\\]++)*+`" if mask_strings else ""
    rest = r"""[^"'/`]++""" if mask_strings else r"""[^"'/]++"""
    token = (
        r"""(?s)"(?:\\.|[^"\\]++)*+"|'(?:\\.|[^'\\]++)*+'""" + tick
        + r"|//[^\n]*+|/\*.*?\*/|" + rest + "|.")
    blank = lambda t: F.regexp_replace(t, r"[^\n]", " ")
    is_comment = lambda t: t.startswith("//") | t.startswith("/*")

    def clean(t: Column) -> Column:
        out = F.when(is_comment(t), blank(t))
        if mask_strings:
            out = out.when(t.rlike(r"""(?s)^["'`].*\s"""), blank(t))
        return out.otherwise(t)

    tokens = F.regexp_extract_all(content, F.lit(token), F.lit(0))
    needs = content.contains("//") | content.contains("/*")
    if mask_strings:
        needs = needs | content.rlike(r"""["'`]""")
    return F.when(needs, F.array_join(F.transform(tokens, clean), "")).otherwise(content)


def python_lines(content: Column) -> Column:
    """Line mode: ``import`` lists and ``from`` lines, no look at other lines."""

    def per_line(text: Column, n: Column) -> Column:
        t = _trimmed(text)
        # commas inside parentheses do not separate names
        names = F.split(F.regexp_extract(t, PY_IMPORT, 1), r",(?![^(]*\))")
        cut = F.transform(names, lambda x: _trimmed(F.regexp_replace(_trimmed(x), r"(?<=.) as .*$", "")))
        plain = F.transform(
            F.filter(cut, lambda x: x != ""),
            lambda x: F.struct(x.alias("module"), F.lit("module").alias("type"),
                               n.cast("int").alias("line")))
        module = F.regexp_extract(t, PY_FROM, 1)
        single = F.array(F.struct(module.alias("module"), F.lit("from").alias("type"),
                                  n.cast("int").alias("line")))
        skip = (t == "") | t.startswith("#") | t.endswith("\\")
        return (
            F.when(skip, _none()).when(t.rlike(PY_IMPORT), plain)
            .when(module != "", single).otherwise(_none()))

    return _by_line(content, "import", per_line)


def python_exact(content: Column) -> Column:
    """Exact mode: the syntax tree; a file that does not parse has no rows."""

    # defined here so that workers need no copy of this package
    def rows_of(text: str | None) -> list[dict]:
        if not text:
            return []
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        rows = []
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                rows += [{"module": a.name, "type": "module", "line": node.lineno}
                         for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                name = "." * node.level + (node.module or "")
                rows.append({"module": name, "type": "from", "line": node.lineno})
        return sorted(rows, key=lambda r: r["line"])

    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(rows_of)

    return F.pandas_udf(parse, ROWS)(content)


def _js_line(text: Column, n: Column, typed: bool) -> Column:
    t = _trimmed(text)
    groups = [_hits(text, p, "module", n) for p in JS_ES6]
    groups += [_hits(text, JS_REQUIRE, "from", n), _hits(text, JS_DYNAMIC, "module", n)]
    if typed:
        groups.append(_hits(text, TS_TYPE, "from", n))
    return F.when(t.startswith("//") | t.startswith("/*"), _none()).otherwise(F.concat(*groups))


def javascript_lines(content: Column) -> Column:
    return _by_line(content, "import|require", lambda t, n: _js_line(t, n, False))


def typescript_lines(content: Column) -> Column:
    return _by_line(content, "import|require", lambda t, n: _js_line(t, n, True))


def javascript_exact(content: Column) -> Column:
    """Statement forms over several lines and re-exports; comments ignored."""
    def statements(clean: Column, pattern: str, kind: str) -> Column:
        return F.transform(match_lines(clean, pattern), lambda x: F.struct(
            F.regexp_extract(x["m"], pattern, 1).alias("module"), F.lit(kind).alias("type"),
            x["line"].alias("line")))

    # the cleaned text is a lambda variable, so it is computed once for all patterns
    found = F.transform(
        F.array(strip_comments(content, mask_strings=True)),
        lambda clean: F.concat(*[statements(clean, p, kind) for p, kind in JS_EXACT]))
    return F.when(content.rlike("import|require|export"), F.flatten(found)).otherwise(_none())


def typescript_exact(content: Column) -> Column:
    """Exact JavaScript forms plus ``import type`` lines."""
    typed = _by_line(content, "import", lambda t, n: F.when(
        _trimmed(t).rlike(r"^(//|/\*)"), _none()).otherwise(_hits(t, TS_TYPE, "from", n)))
    exact = F.filter(javascript_exact(content), lambda x: x["module"] != "")
    return F.concat(exact, typed)


def go_imports(content: Column) -> Column:
    def single(text: Column, n: Column) -> Column:
        t = _trimmed(text)
        return F.when(t.rlike(r"^(//|/\*)"), _none()).otherwise(_hits(t, GO_SINGLE, "module", n))

    def items(block: Column) -> Column:
        lines = F.transform(
            F.split(F.regexp_replace(block["m"], r"^import(\s*)\(", "$1"), "\n"),
            lambda t, i: F.struct(t.alias("t"), (block["line"] + i).alias("n")))
        return F.flatten(F.transform(lines, lambda x: F.when(
            _trimmed(x["t"]).rlike(r"^(//|/\*)"), _none()
        ).otherwise(_hits(x["t"], GO_ITEM, "module", x["n"]))))

    blocks = F.flatten(F.transform(match_lines(content, GO_BLOCK), items))
    return F.concat(_by_line(content, "import", single), blocks)


def java_imports(content: Column) -> Column:
    def per_line(text: Column, n: Column) -> Column:
        t = _trimmed(text)
        static = F.when(t.contains("static"), "from").otherwise("module")
        return F.transform(
            F.regexp_extract_all(t, F.lit(JAVA_IMPORT), F.lit(1)),
            lambda m: F.struct(m.alias("module"), static.alias("type"),
                               n.cast("int").alias("line")))

    return F.when(
        content.contains("import"), _by_line(strip_comments(content), "import", per_line)
    ).otherwise(_none())


def _keyword_lines(keyword: str, comment: str, patterns: list[tuple[str, str]]) -> Extractor:
    def run(content: Column) -> Column:
        def per_line(text: Column, n: Column) -> Column:
            t = _trimmed(text)
            return F.when(t.startswith(comment), _none()).otherwise(
                F.concat(*[_hits(t, p, kind, n) for p, kind in patterns]))

        return _by_line(content, keyword, per_line)

    return run


ruby_imports = _keyword_lines("require|load", "#", RUBY)
cpp_includes = _keyword_lines("include", "//", CPP)
rust_imports = _keyword_lines("mod|use|crate", "//", RUST)

_LINE: dict[str, Extractor] = {
    "python": python_lines, "javascript": javascript_lines, "typescript": typescript_lines,
    "go": go_imports, "java": java_imports, "ruby": ruby_imports, "cpp": cpp_includes,
    "rust": rust_imports,
}
_EXACT: dict[str, Extractor] = {
    **_LINE, "python": python_exact, "javascript": javascript_exact,
    "typescript": typescript_exact,
}
_custom: dict[str, Extractor] = {}


def register_extractor(ext: str, fn: Extractor) -> None:
    """Add or replace the extractor of an extension.

    ``fn`` maps the content column to ``ARRAY<STRUCT<module, type, line>>``; it may
    be a plain expression or call an Arrow UDF of that return type.
    """
    _custom[ext] = fn


def unregister_extractor(ext: str) -> None:
    _custom.pop(ext, None)


def supported_extensions() -> list[str]:
    return sorted({*FAMILY_OF_EXT, *_custom})


def _extracted(files: DataFrame, mode: str, extensions: list[str] | None) -> DataFrame:
    if mode not in ("exact", "line"):
        raise ValueError("mode is 'exact' or 'line'")
    table = _EXACT if mode == "exact" else _LINE
    wanted = [e for e in supported_extensions() if extensions is None or e in extensions]
    found = None
    by_fn: dict[Extractor, list[str]] = {}
    for ext in wanted:
        fn = _custom.get(ext) or table[FAMILY_OF_EXT[ext]]
        by_fn.setdefault(fn, []).append(ext)
    text = F.regexp_replace("content", "\r\n?", "\n")
    base = files.where(F.col("ext").isin(wanted)).withColumn("content", text)
    for fn, exts in by_fn.items():
        mine = F.col("ext").isin(exts)
        # a null text keeps other languages' content out of a Python worker
        rows = fn(F.when(mine, F.col("content")))
        found = F.when(mine, rows) if found is None else found.when(mine, rows)
    return base.withColumn("found", F.coalesce(found, _none()) if found is not None else _none())


def extract_imports(
    files: DataFrame, mode: str = "exact", extensions: list[str] | None = None
) -> DataFrame:
    """``files`` to import rows in one pass over the table.

    ``mode='exact'`` reads Python by syntax tree and JavaScript by statements,
    ``'line'`` uses the line patterns for every language.
    """
    return (
        _extracted(files, mode, extensions)
        .select("repo", F.col("path").alias("source_file"), F.posexplode("found").alias("pos", "r"))
        .select("repo", "source_file", F.col("r.module").alias("imported_module"),
                F.col("r.type").alias("import_type"), F.col("r.line").alias("line_number"), "pos"))


def parse_warnings(files: DataFrame, mode: str = "exact") -> DataFrame:
    """A warning row for every non-empty supported file without import rows."""
    return _extracted(files, mode, None).where(
        (F.size("found") == 0) & (F.col("size_bytes") > 0)
    ).select("repo", "path", F.concat(F.lit("Could not parse "), "path").alias("warning"))


def import_locations(files: DataFrame) -> DataFrame:
    """Import statements as written, with the names they bind (Python and JavaScript)."""
    rows = (
        files.where(F.col("ext").isin(".py", ".js", ".jsx", ".ts", ".tsx", ".mjs"))
        .select("repo", "path", "ext", F.posexplode(F.split("content", "\n")).alias("i", "raw"))
        .where(F.col("raw").rlike("import|require|from"))
        .withColumn("t", _trimmed(F.col("raw")))
    )
    t = F.col("t")
    first = lambda x: F.split(_trimmed(x), r"\s+")[0]
    listed = F.transform(
        F.filter(F.split(F.regexp_replace(F.regexp_replace(t, r"^.*?import", ""), r"#.*$", ""), ","),
                 lambda x: _trimmed(x) != ""), first)
    py = F.when(t.rlike(r"^(import|from) "), F.struct(
        F.when(t.startswith("from"), "from_import").otherwise("import").alias("kind"),
        F.when(t.contains("import"), listed).otherwise(F.array().cast("array<string>"))
        .alias("names")))
    left = _trimmed(F.regexp_replace(F.split(t, " from ")[0], r"^import", ""))
    braces = F.transform(F.split(F.regexp_extract(left, r"\{([^}]*)", 1), ","), first)
    none = F.array().cast("array<string>")
    bound = (
        F.when(~t.contains(" from "), none).when(left.contains("{"), braces)
        .when((left != "") & ~left.startswith("*"), F.array(first(left))).otherwise(none))
    js = (
        F.when(t.startswith("import "), F.struct(F.lit("import").alias("kind"), bound.alias("names")))
        .when(t.contains("require(") & t.rlike("const |let |var "),
              F.struct(F.lit("require").alias("kind"), none.alias("names")))
        .when(t.contains("import("),
              F.struct(F.lit("dynamic").alias("kind"), none.alias("names"))))
    return rows.withColumn("r", F.when(F.col("ext") == ".py", py).otherwise(js)).where(
        "r IS NOT NULL"
    ).select("repo", "path", (F.col("i") + 1).alias("line_number"), t.alias("line_content"),
             F.col("r.kind").alias("import_type"), F.col("r.names").alias("imported_names"))
