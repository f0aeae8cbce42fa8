"""Import resolution as a ranked equi-join against the files table.

Each distinct question (repo, language, folder, module) gets an ordered list of
candidate paths; the candidates are joined with the known paths and the lowest
rank wins.  Asking each question once keeps a module that a third of all files
import from becoming a hot join key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.languages import FAMILY_OF_EXT, lookup
from srcgraph.functions.paths import drop_extension, extension, folder_path, join_path, resolve_dots
from srcgraph.stage import Stage

# fixed values: order in which script suffixes are tried
JS_SUFFIXES = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]

# fixed values: top-level names of the Python standard library
PYTHON_STDLIB = [
    "abc", "aifc", "argparse", "array", "ast", "asynchat", "asyncio", "asyncore", "base64", "bdb",
    "binascii", "bisect", "builtins", "bz2", "calendar", "cgi", "cgitb", "chunk", "cmath", "cmd",
    "code", "codecs", "codeop", "collections", "colorsys", "compileall", "concurrent",
    "configparser", "contextlib", "contextvars", "copy", "copyreg", "cProfile", "crypt", "csv",
    "ctypes", "curses", "dataclasses", "datetime", "dbm", "decimal", "difflib", "dis", "distutils",
    "doctest", "email", "encodings", "enum", "errno", "faulthandler", "fcntl", "filecmp",
    "fileinput", "fnmatch", "fractions", "ftplib", "functools", "gc", "getopt", "getpass",
    "gettext", "glob", "graphlib", "grp", "gzip", "hashlib", "heapq", "hmac", "html", "http",
    "idlelib", "imaplib", "imghdr", "imp", "importlib", "inspect", "io", "ipaddress", "itertools",
    "json", "keyword", "lib2to3", "linecache", "locale", "logging", "lzma", "mailbox", "mailcap",
    "marshal", "math", "mimetypes", "mmap", "modulefinder", "multiprocessing", "netrc", "nis",
    "nntplib", "numbers", "operator", "optparse", "os", "ossaudiodev", "pathlib", "pdb", "pickle",
    "pickletools", "pipes", "pkgutil", "platform", "plistlib", "poplib", "posix", "posixpath",
    "pprint", "profile", "pstats", "pty", "pwd", "py_compile", "pyclbr", "pydoc", "queue", "quopri",
    "random", "re", "readline", "reprlib", "resource", "rlcompleter", "runpy", "sched", "secrets",
    "select", "selectors", "shelve", "shlex", "shutil", "signal", "site", "smtpd", "smtplib",
    "sndhdr", "socket", "socketserver", "spwd", "sqlite3", "ssl", "stat", "statistics", "string",
    "stringprep", "struct", "subprocess", "sunau", "sunaudio", "symtable", "sys", "sysconfig",
    "syslog", "tabnanny", "tarfile", "telnetlib", "tempfile", "termios", "test", "textwrap",
    "threading", "time", "timeit", "tkinter", "token", "tokenize", "trace", "traceback",
    "tracemalloc", "tty", "turtle", "turtledemo", "types", "typing", "unicodedata", "unittest",
    "urllib", "uu", "uuid", "venv", "warnings", "wave", "weakref", "webbrowser", "winreg",
    "winsound", "wsgiref", "xdrlib", "xml", "xmlrpc", "zipapp", "zipfile", "zipimport", "zlib",
    "_thread",
]

# fixed values: modules built into Node
NODE_BUILTIN = [
    "assert", "async_context", "async_hooks", "buffer", "child_process", "cluster", "console",
    "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "globals", "http",
    "http2", "https", "inspector", "intl", "module", "net", "os", "path", "perf_hooks",
    "permissions", "process", "querystring", "readline", "repl", "report", "sqlite", "stream",
    "string_decoder", "test", "timers", "tls", "tracing", "tty", "url", "util", "v8", "vm", "wasi",
    "webcrypto", "webstreams", "worker_threads", "zlib",
]

# fixed values: package prefixes of the Java platform (sub-packages are covered by their prefix)
JAVA_PREFIXES = [
    "java.applet", "java.awt", "java.beans", "java.io", "java.lang", "java.math", "java.net",
    "java.nio", "java.rmi", "java.security", "java.sql", "java.text", "java.time", "java.util",
    "javax.accessibility", "javax.annotation", "javax.imageio", "javax.jws", "javax.lang.model",
    "javax.management", "javax.naming", "javax.net", "javax.print", "javax.script",
    "javax.security.auth", "javax.security.cert", "javax.security.sasl", "javax.smartcardio",
    "javax.sound.midi", "javax.sound.sampled", "javax.sql", "javax.swing", "javax.tools",
    "javax.transaction", "javax.xml", "jdk.dynalink", "jdk.incubator.concurrent",
    "jdk.incubator.vector", "jdk.javadoc.doclet", "jdk.jshell", "jdk.management", "jdk.net",
    "jdk.nio.mapmode", "jdk.security.auth.module",
]

_JAVA_RX = "^(" + "|".join(p.replace(".", r"\.") for p in JAVA_PREFIXES) + r")(\.|$)"
PATHS = "array<string>"
Bases = Callable[[Column, Column, dict[str, Column]], Column]
Forms = Callable[[Column], list[Column]]


def resolver_of_ext(ext) -> Column:
    """Resolver family by extension (case ignored); Python when unknown."""
    families = {**FAMILY_OF_EXT, ".ts": "javascript", ".tsx": "javascript"}
    families = {k: ("javascript" if v == "typescript" else v) for k, v in families.items()}
    ext = F.col(ext) if isinstance(ext, str) else ext
    found = lookup(F.lower(ext), families)
    for custom, lang in _custom_ext.items():
        found = F.when(F.lower(ext) == custom, F.lit(lang)).otherwise(found)
    return F.coalesce(found, F.lit("python"))


def _with(base: Column, suffix: str) -> Column:
    """Replace the suffix of the last segment."""
    return F.concat(drop_extension(base), F.lit(suffix))


def _as_dirs(module: Column) -> Column:
    return F.translate(module, ".", "/")


def _python_bases(folder: Column, module: Column, cfg: dict[str, Column]) -> Column:
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)))
    local = F.concat(folder, up, F.lit("/"), _as_dirs(F.regexp_replace(module, r"^\.+", "")))
    return F.array(F.when(dots > 0, local).otherwise(_as_dirs(module)))


def _python_forms(base: Column) -> list[Column]:
    return [join_path(base, F.lit("__init__.py")), _with(base, ".py"), F.concat(base, F.lit(".py"))]


def _js_bases(folder: Column, module: Column, cfg: dict[str, Column]) -> Column:
    # the first alias that fits decides; there is no second try without it
    alias = F.get(F.filter(cfg["aliases"], lambda a: module.startswith(a["alias"])), 0)
    rest = F.substring(module, F.length(alias["alias"]) + 1, F.length(module))
    return F.array(
        F.when(module.startswith("."), F.concat_ws("/", folder, module))
        .when(module.startswith("/") | alias.isNull(), module)
        .otherwise(F.concat_ws("/", alias["target"], rest)))


def _js_forms(base: Column) -> list[Column]:
    exact = F.when(extension(base).isin(JS_SUFFIXES), base)
    return [exact, *[_with(base, s) for s in JS_SUFFIXES],
            *[join_path(base, F.lit("index" + s)) for s in JS_SUFFIXES]]


def _go_bases(folder: Column, module: Column, cfg: dict[str, Column]) -> Column:
    rest = F.substring(module, F.length(cfg["go_module"]) + 1, F.length(module))
    return F.array(F.when(~_is_go_std(module), F.when(
        module.rlike(r"^\.\.?/"), F.concat_ws("/", folder, module)
    ).when(module.startswith(cfg["go_module"]), rest)))


def _go_forms(base: Column) -> list[Column]:
    # a Go target is a folder with Go files
    return [F.concat(F.lit("dir:"), F.when(base == "", ".").otherwise(base))]


def _java_bases(folder: Column, module: Column, cfg: dict[str, Column]) -> Column:
    closed = module.endswith(".*") | module.rlike(_JAVA_RX)
    return F.when(~closed, F.transform(cfg["java_roots"], lambda r: join_path(r, _as_dirs(module))))


def _ruby_bases(folder: Column, module: Column, cfg: dict[str, Column]) -> Column:
    near = F.concat_ws("/", folder, module)
    return F.when(module.rlike(r"^\.\.?/"), F.array(near)).otherwise(
        F.array(near, module, F.concat(F.lit("lib/"), module)))


def _cpp_bases(folder: Column, module: Column, cfg: dict[str, Column]) -> Column:
    return F.array(F.concat_ws("/", folder, module), module, *[
        F.concat(F.lit(d + "/"), module) for d in ("include", "inc", "src")])


def _rust_bases(folder: Column, module: Column, cfg: dict[str, Column]) -> Column:
    inner = F.replace(F.regexp_replace(module, r"^crate::", ""), F.lit("::"), F.lit("/"))
    return F.array(F.when(~module.contains("::"), F.concat_ws("/", folder, module))
                   .when(module.startswith("crate::"), F.concat(F.lit("src/"), inner)))


# per language: the paths a module may mean, and the file names tried for such a path
_BASES: dict[str, Bases] = {
    "python": _python_bases, "javascript": _js_bases, "go": _go_bases, "java": _java_bases,
    "ruby": _ruby_bases, "cpp": _cpp_bases, "rust": _rust_bases,
}
_FORMS: dict[str, Forms] = {
    "python": _python_forms, "javascript": _js_forms, "go": _go_forms,
    "java": lambda b: [F.concat(b, F.lit(".java"))],
    "ruby": lambda b: [b, F.when(extension(b) == "", F.concat(b, F.lit(".rb")))],
    "cpp": lambda b: [b],
    "rust": lambda b: [F.concat(b, F.lit(".rs")), F.concat(b, F.lit("/mod.rs"))],
}


def _is_go_std(module: Column) -> Column:
    # every listed package has a first part without a dot, so the dot rule decides
    return ~F.substring_index(module, "/", 1).contains(".")


_STD: dict[str, Callable[[Column], Column]] = {
    "python": lambda m: ~m.startswith(".") & F.trim(F.substring_index(m, ".", 1)).isin(PYTHON_STDLIB),
    "javascript": lambda m: F.when(
        F.trim(m).startswith("node:"), F.substr(F.trim(m), F.lit(6)).isin(NODE_BUILTIN)
    ).otherwise(F.substring_index(F.substring_index(F.trim(m), "/", 1), "@", -1).isin(NODE_BUILTIN)),
    "go": _is_go_std,
    "java": lambda m: F.regexp_replace(F.rtrim(m), r"\*+$|\.\*$|\.+$", "").rlike(_JAVA_RX),
}
_custom_ext: dict[str, str] = {}


def register_resolver(lang: str, bases: Bases, forms: Forms | None = None, stdlib=None,
                      extensions: list[str] | None = None) -> None:
    """Add or replace the resolver of a language.

    ``bases(folder, module, config)`` returns the ranked paths a module may mean as
    an array column (``.`` and ``..`` are folded afterwards); ``forms(path)`` lists
    the file names tried for one path, default the path itself.  ``stdlib`` is a
    list of top-level names or a column predicate.
    """
    _BASES[lang] = bases
    _FORMS[lang] = forms or (lambda b: [b])
    if callable(stdlib):
        _STD[lang] = stdlib
    elif stdlib:
        names = list(stdlib)
        _STD[lang] = lambda m: F.substring_index(m, ".", 1).isin(names)
    for ext in extensions or []:
        _custom_ext[ext.lower()] = lang


_BUILT_IN = (dict(_BASES), dict(_FORMS), dict(_STD))


def unregister_resolver(lang: str) -> None:
    """Undo ``register_resolver``; a built-in language gets its own rules back."""
    for table, own in zip((_BASES, _FORMS, _STD), _BUILT_IN, strict=True):
        table.pop(lang, None)
        if lang in own:
            table[lang] = own[lang]
    for ext in [e for e, name in _custom_ext.items() if name == lang]:
        del _custom_ext[ext]


def is_stdlib(lang, module) -> Column:
    """Whether a module that is not in the project belongs to the language itself."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    module = F.col(module) if isinstance(module, str) else module
    out = F.lit(False)
    for name, test in _STD.items():
        out = F.when(lang == name, test(module)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _local(lang: Column, module: Column) -> Column:
    """Whether the importing folder takes part in the question."""
    dotted = lang.isin("python", "javascript", "go") & module.startswith(".")
    near = lang.isin("ruby", "cpp") | ((lang == "rust") & ~module.contains("::"))
    known = lang.isin("python", "javascript", "go", "java", "ruby", "cpp", "rust")
    return dotted | near | ~known


def candidate_paths(questions: DataFrame, cfg: dict[str, Column]) -> DataFrame:
    """Questions with ``rank, known``: one row per candidate path, best rank first."""
    lang, none = F.col("lang"), F.array().cast(PATHS)
    bases, forms = none, none
    for name, fn in _BASES.items():
        bases = F.when(lang == name, fn(F.col("folder"), F.col("imported_module"), cfg)).otherwise(bases)
    for name, fn in _FORMS.items():
        forms = F.when(lang == name, F.flatten(_expand(fn))).otherwise(forms)
    return (
        questions.withColumn("bases", bases).withColumn("bases", F.transform("bases", resolve_dots))
        .select("repo", "lang", "folder", "imported_module", F.posexplode(forms).alias("rank", "known"))
        .where("known IS NOT NULL"))


def _expand(forms: Forms) -> Column:
    return F.transform("bases", lambda b: F.array(*forms(b)))


def known_paths(files: DataFrame) -> DataFrame:
    """Join targets: every file, and every folder that holds Go files as ``dir:``."""
    packages = files.where("ext = '.go'").select("repo", folder_path("path").alias("d")).distinct()
    roots = files.where("path = 'go.mod'").select("repo", F.lit("dir:.").alias("known"))
    return (
        files.select("repo", F.col("path").alias("known"))
        .unionByName(packages.select("repo", F.concat(
            F.lit("dir:"), F.when(F.col("d") == "", ".").otherwise(F.col("d"))).alias("known")))
        .unionByName(roots).distinct())


def resolve_imports(imports: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """Add ``lang, target, external_kind`` (null when internal) to import rows.

    ``configs`` is one row per repo: ``go_module, aliases, java_roots`` (see
    ``sources.configs``).  The target is the resolved path or the raw module.
    """
    asked = imports.withColumn(
        "lang", resolver_of_ext(extension("source_file"))
    ).withColumn("folder", F.when(
        _local(F.col("lang"), F.col("imported_module")), folder_path("source_file")
    ).otherwise(""))
    # read twice below; written once, so that the extraction behind it runs once
    asked, _ = Stage(imports.sparkSession, "imports").save(asked)
    questions = asked.select("repo", "lang", "folder", "imported_module").distinct()
    none = F.array().cast("array<struct<alias:string,target:string>>")
    cfg = {
        "go_module": F.col("go_module"), "aliases": F.coalesce("aliases", none),
        "java_roots": F.coalesce("java_roots", F.array(F.lit(""))),
    }
    ranked = candidate_paths(questions.join(configs, "repo", "left"), cfg)
    answers = (
        ranked.join(known_paths(files), ["repo", "known"])
        .groupBy("repo", "lang", "folder", "imported_module")
        .agg(F.regexp_replace(F.min_by("known", "rank"), "^dir:", "").alias("hit"))
    )
    joined = asked.join(answers, ["repo", "lang", "folder", "imported_module"], "left")
    return joined.select(
        *[c for c in imports.columns], "lang",
        F.coalesce("hit", "imported_module").alias("target"),
        F.when(F.col("hit").isNull(), F.when(is_stdlib("lang", "imported_module"), "stdlib")
               .otherwise("package")).alias("external_kind"))
