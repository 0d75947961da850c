"""Go source trees: which files import a module, and the names that they take from it.

Everything is built from string functions, so files are scanned in the JVM, in parallel. A file is cut
into comments, string, raw string and rune constants, and what stands between them; line ends are kept,
so that places in what is left are places in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.functions.scalars import package_alias
from heftgraph.operators.prefix import longest

SKIPPED = r"(^|/)(vendor|testdata|\.[^/]+)/|_test\.go$"


def read(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), text of the tree's Go files, without tests, vendored and hidden folders."""
    base = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.go").text(base, wholetext=True)
    return sources(files.select(F.element_at(F.split(F.col("_metadata.file_path"), F.concat(F.lit(r"\Q"), F.lit(base), F.lit(r"\E/")), 2), -1).alias("path"), F.col("value").alias("text")))


def sources(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("path").rlike(SKIPPED))


#: Comments, constants and runs of other text. No group is repeated, so a long constant needs no stack.
_TOKEN = r"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|"[^"\n]*"|`[^`]*`?|'[^'\n]*'|[^/"`']+|."""


def _tokens(text: Column) -> Column:
    """The pieces of a file; of constants, the escapes of quotes and of backslashes are left out."""
    return F.regexp_extract_all(F.regexp_replace(text, r"""\\[\\"']""", ""), F.lit(_TOKEN), 0)


def _line_ends(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\n]+", " ")


def _code(tokens: Column) -> Column:
    """A file without comments, and without constants of several lines, which aren't import paths."""
    kept = lambda t: F.when(t.rlike(r"^(//|/\*)|(?s)^`.*\n"), _line_ends(t)).otherwise(t)
    return F.array_join(F.transform(tokens, kept), "")


def _uses(tokens: Column) -> Column:
    """Array of (a, s): the exported names s that are taken from a name a, outside comments and constants."""
    bare = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^(//|/\\*|[\"'`])"), F.when(t.rlike("^[\"'`]"), F.lit('""')).otherwise(_line_ends(t))).otherwise(t)), "")
    joined = F.regexp_replace(F.regexp_replace(bare, r"\.{3}", " "), r"[ \t]*\.\s*", ".")
    rx = F.lit(r"(?<![\w.])(\w+)\.(\p{Lu}\w*)")
    return F.array_distinct(F.arrays_zip(F.regexp_extract_all(joined, rx, 1).alias("a"), F.regexp_extract_all(joined, rx, 2).alias("s")))


def _specs(text: Column) -> Column:
    """All import lines: those of blocks, and single ones."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^import\s*\((.*?)\)"), 1)
    single = F.regexp_extract_all(text, F.lit(r'(?m)^import[ \t]+([^(\n]+)$'), 1)
    return F.concat(F.flatten(F.transform(blocks, lambda b: F.split(b, r"[\n;]"))), single)


_SPEC = r'^\s*(?:import\s+)?([\w.]*)\s*["`]([^"`]+)["`]'


def import_sites(files: DataFrame) -> DataFrame:
    """path, line, import, alias, symbols (sorted distinct exported names used) of every import of files(path, text).

    Blank and dot imports have the alias _ or . and no symbols; line counts from 1.
    """
    cut = files.select("path", _tokens(F.col("text")).alias("tokens")).select("path", _code(F.col("tokens")).alias("code"), _uses(F.col("tokens")).alias("uses"))
    # 'name|path' of every line that may be an import, to find the lines again
    lines = F.transform(F.split("code", r"\r?\n"), lambda line: F.concat(F.regexp_extract(line, _SPEC, 1), F.lit("|"), F.regexp_extract(line, _SPEC, 2)))
    found = cut.select("path", lines.alias("lines"), "uses", F.explode(_specs(F.col("code"))).alias("spec"))
    named = found.select("path", "lines", "uses", F.regexp_extract("spec", _SPEC, 1).alias("given"), F.regexp_extract("spec", _SPEC, 2).alias("import")).filter("import <> ''")
    named = named.withColumn("alias", F.when(F.col("given") != "", F.col("given")).otherwise(package_alias(F.col("import"))))
    symbols = F.array_sort(F.array_distinct(F.transform(F.filter("uses", lambda u: u["a"] == F.col("alias")), lambda u: u["s"])))
    line = F.array_position("lines", F.concat("given", F.lit("|"), "import")).cast("int")
    return named.select("path", line.alias("line"), "import", "alias", symbols.alias("symbols"))


def directory(path: Column) -> Column:
    """The folder of a file, '.' at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def package_of_folder(folders: DataFrame, modules: DataFrame) -> DataFrame:
    """folder, from_package of folders(folder): the path of the innermost of modules(module, dir) around it, and what lies below."""
    rooted = lambda c: F.when(F.col(c) == ".", "root").otherwise(F.concat(F.lit("root/"), c))
    known = modules.select(F.col("module").alias("name"), rooted("dir").alias("module"))
    held = longest(folders.select(rooted("folder").alias("at")), "at", known)
    below = F.substring("at", F.length("module") + 1, F.length("at"))
    named = held.join(known, "module").select(F.expr("if(at = 'root', '.', substring(at, 6))").alias("folder"), F.concat("name", below).alias("from_package"))
    return named.distinct()


def sites_of(files: DataFrame, module: str, modules: DataFrame | None = None) -> DataFrame:
    """import_sites of the packages of one module; with modules(module, dir), each with the package it stands in."""
    out = import_sites(files).filter((F.col("import") == module) | F.col("import").startswith(module + "/"))
    if modules is None:
        return out
    out = out.withColumn("folder", directory(F.col("path")))
    return out.join(package_of_folder(out, modules), "folder", "left").drop("folder")


def coupling(files: DataFrame, packages: DataFrame, main: str) -> DataFrame:
    """module, import_sites, importing_packages, distinct_symbols over files(path, text) of the main module's tree.

    packages(pkg, module, name) tells modules, and the names that packages go by where an import
    gives none. Blank and dot imports are sites without symbols. A name stands for the last of a
    file's imports that gives it.
    """
    known = packages.filter((F.col("module") != "") & (F.col("module") != main)).select(F.col("pkg").alias("import"), "module", "name").distinct()
    code = import_sites(files).select("path", "line", "import", "alias").join(known, "import")
    given = F.col("alias") != package_alias(F.col("import"))
    local = code.withColumn("local", F.when(given | (F.coalesce("name", F.lit("")) == ""), F.col("alias")).otherwise(F.col("name")))
    sites = local.groupBy("module").agg(F.count("*").alias("import_sites"), F.count_distinct(directory(F.col("path"))).alias("importing_packages"))
    names = local.filter("local not in ('_', '.')").groupBy("path", "local").agg(F.max_by("module", "line").alias("module"))
    used = files.select("path", F.explode(_uses(_tokens(F.col("text")))).alias("u")).select("path", F.col("u.a").alias("local"), F.col("u.s").alias("symbol"))
    symbols = used.join(names, ["path", "local"]).groupBy("module").agg(F.count_distinct(F.concat_ws(".", "local", "symbol")).alias("distinct_symbols"))
    return sites.join(symbols, "module", "left").select("module", "import_sites", "importing_packages", F.coalesce("distinct_symbols", F.lit(0)).alias("distinct_symbols"))
