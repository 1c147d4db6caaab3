"""Source trees: listing, languages, imports, manifests of packages and of builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories never entered, and the languages by extension.
IGNORED = ("node_modules", ".git", "dist", "build", "out", ".next", "vendor", "__pycache__", ".venv", "venv", "target", "obj", "bin")
LANGUAGES = {
    ".ts": "ts", ".tsx": "ts", ".mts": "ts", ".cts": "ts", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".py": "py", ".java": "java",
    ".cs": "cs", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp",
}
MINIFIED = r"(?i)\.min\.[^./]+$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of the path's extension, or null."""
    out = F.lit(None).cast("string")
    for ext, lang in LANGUAGES.items():
        out = F.when(extension(path) == ext, lang).otherwise(out)
    return out


def is_config(path: Column) -> Column:
    return path.rlike(r"(?i)\.ya?ml$")


def listed(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths of known languages or YAML, outside ignored directories and not minified."""
    c = F.col(path)
    folders = F.slice(F.split(c, "/"), F.lit(1), F.size(F.split(c, "/")) - 1)
    inside = F.exists(folders, lambda x: x.isin(*IGNORED))
    return paths.where((language(c).isNotNull() | is_config(c)) & ~inside & ~c.rlike(MINIFIED))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, content, hash) of the files of a tree that count as sources, path being relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    rows = files.select(F.element_at(F.split("path", base, 2), -1).alias("path"), F.unix_millis("modificationTime").cast("double").alias("mtime"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"))
    return listed(rows)


def _statements(content: Column, end: str) -> Column:
    """The words of each statement, the last line of what stands before its end."""
    return F.transform(F.split(content, end), lambda x: F.split(F.trim(F.element_at(F.split(F.rtrim(x), "\n"), -1)), r"\s+"))


def _plain(module: Column, names: Column | None = None) -> Column:
    return F.struct(module.alias("module"), (F.array().cast("array<string>") if names is None else names).alias("names"))


def _names(text: Column) -> Column:
    """The names in a list of imports: of each item its first word, of `* as x` its last."""
    items = F.filter(F.transform(F.split(F.translate(text, "{}()", ""), ","), lambda x: F.split(F.trim(x), r"\s+")), lambda x: x[0] != "")
    return F.filter(F.transform(items, lambda x: F.when(x[0] == "*", F.element_at(x, -1)).otherwise(x[0])), lambda x: x.rlike(r"^\w+$"))


def _of_scripts(content: Column) -> Column:
    """What follows the words import and require up to a quoted module: a clause that ends in `from`, a bracket or nothing."""

    def after(word: str) -> Column:
        texts = F.slice(F.split(content, rf"\b{word}\b"), 2, 1 << 30)
        quoted = F.transform(texts, lambda x: F.split(F.translate(x, "'", '"'), '"'))
        return F.transform(F.filter(quoted, lambda x: F.size(x) > 2), lambda x: F.struct(F.trim(F.regexp_replace(x[0], r"\s+", " ")).alias("clause"), x[1].alias("module")))

    listed = F.filter(after("import"), lambda x: x["clause"].rlike(r"^[\w\s{},*$]*[\s}]from$"))
    with_names = F.transform(listed, lambda x: _plain(x["module"], _names(F.regexp_replace(F.regexp_replace(x["clause"], " ?from$", ""), r"^type (?=\S)", ""))))
    bare = F.filter(after("import"), lambda x: x["clause"].isin("", "("))
    return F.concat(with_names, F.transform(bare, lambda x: _plain(x["module"])), F.transform(F.filter(after("require"), lambda x: x["clause"] == "("), lambda x: _plain(x["module"])))


def _of_python(content: Column) -> Column:
    """Lines that begin with `from` or `import`; of a list that goes on in other lines, what stands in its first."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(F.substring_index(x, "#", 1), r"\s+", " ")))
    chosen = F.filter(lines, lambda x: F.startswith(x, F.lit("from ")) & F.contains(x, F.lit(" import ")))
    listed = F.transform(chosen, lambda x: _plain(F.split(x, " ")[1], _names(F.substring_index(x, " import ", -1))))
    whole = F.flatten(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("import "))), lambda x: F.split(F.substring(x, 8, 1 << 30), ",")))
    return F.concat(listed, F.transform(whole, lambda x: _plain(F.split(F.trim(x), " ")[0])))


def _of_words(content: Column, keyword: str) -> Column:
    """Statements of the keyword and a dotted name, with `static` between them or an alias before it."""
    words = F.filter(_statements(content, ";"), lambda x: (x[0] == keyword) & (F.size(x) > 1) & (x[1] != "var"))
    return F.transform(F.filter(words, lambda x: F.element_at(x, -1).rlike(r"^[\w.]+(\.\*)?$")), lambda x: _plain(F.regexp_replace(F.element_at(x, -1), r"\.\*$", "")))


def _of_pages(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(r"""href\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda x: _plain(x))


IMPORTS = {"ts": _of_scripts, "js": _of_scripts, "py": _of_python, "java": lambda c: _of_words(c, "import"), "cs": lambda c: _of_words(c, "using"), "html": _of_pages}


def imports_of(files: DataFrame, lang: str, content: str = "content") -> DataFrame:
    """files with (module, names) of every import in them."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.explode(IMPORTS[lang](F.col(content))).alias("_x")).select(*keep, "_x.module", "_x.names")


def package_name(name: Column, content: Column) -> Column:
    """The package that a package.json, pom.xml or .csproj declares; null where it declares none or cannot be read."""
    pom = F.from_xml(content, "groupId string, artifactId string, parent struct<groupId:string>", {"mode": "PERMISSIVE"})
    group, artifact = F.trim(F.coalesce(pom["groupId"], pom["parent"]["groupId"])), F.trim(pom["artifactId"])
    build = F.from_xml(content, "PropertyGroup array<struct<AssemblyName:string>>", {"mode": "PERMISSIVE"})
    assembly = F.trim(F.get(F.filter(build["PropertyGroup"]["AssemblyName"], lambda x: x.isNotNull()), F.lit(0)))
    of_pom = F.when(artifact != "", F.concat_ws(":", F.when(group != "", group), artifact))
    return F.when(name == "package.json", F.get_json_object(content, "$.name")).when(name == "pom.xml", of_pom).when(F.endswith(name, F.lit(".csproj")) & (assembly != ""), assembly)


def manifest(files: DataFrame) -> DataFrame:
    """(path, mtime, hash) to keep of a build."""
    return files.select("path", "mtime", "hash")


def page_hosts(pages: DataFrame) -> DataFrame:
    """pages as files: repository the host, path the url's path, content the html."""
    return pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("repo"), F.parse_url("url", F.lit("PATH")).alias("path"), F.col("html").alias("content"))
