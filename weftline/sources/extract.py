"""Extractors: files to nodes, edges and unresolved calls, each file in one row of a partition.

Python is read with the standard library's ast; C-like languages by declarations and matching
braces; YAML by its lines; pre-made symbol indexes by range containment in SQL.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "row string, id string, label string, kind string, source string, target string, relation string, callee string, receiver string, source_file string, line int"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def _row(**kw) -> dict:
    return {c: kw.get(c) for c in COLUMNS}


def stem_id(path: str, *names: str) -> str:
    parts = [re.sub(r"[\W_]+", "_", p.lower()).strip("_") for p in (path, *names)]
    return ":".join(p for p in parts if p)


def extract_python(path: str, text: str) -> list[dict]:
    """Module, classes, functions and methods, what contains what, bases, imports and calls. A file that does not parse gives an error row."""
    module = stem_id(path)
    out = [_row(row="node", id=module, label=path, kind="module", source_file=path, line=1)]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [_row(row="error", label=str(e)[:200], source_file=path, line=getattr(e, "lineno", None))]

    def visit(node: ast.AST, owner: str, names: tuple[str, ...], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                cls = isinstance(child, ast.ClassDef)
                ident, kind = stem_id(path, *names, child.name), "class" if cls else "method" if in_class else "function"
                out.append(_row(row="node", id=ident, label=child.name, kind=kind, source_file=path, line=child.lineno))
                out.append(_row(row="edge", source=owner, target=ident, relation="method" if kind == "method" else "contains", source_file=path, line=child.lineno))
                for base in child.bases if cls else ():
                    name = base.attr if isinstance(base, ast.Attribute) else getattr(base, "id", None)
                    if name:
                        out.append(_row(row="edge", source=ident, target=stem_id(name), relation="inherits", source_file=path, line=child.lineno))
                visit(child, ident, (*names, child.name), cls)
                continue
            if isinstance(child, ast.Import | ast.ImportFrom):
                mod = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                for a in child.names:
                    out.append(_row(row="import", label=a.asname or a.name, target=mod or a.name, source=module, source_file=path, line=child.lineno))
            if isinstance(child, ast.Call):
                f = child.func
                callee = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", None)
                receiver = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else None
                if callee:
                    out.append(_row(row="call", callee=callee, receiver=receiver, source=owner, source_file=path, line=child.lineno))
            visit(child, owner, names, in_class)

    visit(tree, module, (), False)
    return out


DECLARATION = re.compile(r"(?m)(?:^|(?<=[{};]))[ \t]*(?:export\s+|default\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|abstract\s+|final\s+)*(?:(class|interface)\s+(\w+)(?:\s+(?:extends|implements|:)\s+([\w, ]+))?|function\s*\*?\s*(\w+)|(?:[\w<>\[\], ]+\s+)?(\w+)\s*\([^;{}]*\)\s*(?::[^;{=]+)?(?=\{))")
ARROW = re.compile(r"\b(\w+)\s*(?::[^=;{}]+)?=\s*(?:async\b\s*)?(?:\w+|\([^()]*\)\s*(?::[^=;{}]+)?)\s*=>(?=\s*\{)")
CALL = re.compile(r"(?:(\w+)\s*\.\s*)?\b(\w+)\s*\(")
NOT_CALLED = frozenset("if for while switch catch return function new typeof sizeof super constructor do else throw await".split())


def blank_strings(text: str) -> str:
    """The text with the contents of comments and strings blanked, of the same length."""
    pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def brace_spans(text: str) -> list[tuple[str, str, int, int, str | None]]:
    """(name, kind, start, end, bases) of declarations and named arrow functions with a body, by matching braces."""
    clean, out = blank_strings(text), []
    found = [(m, m[2] or m[4] or m[5], m[1] or "function", m[3]) for m in DECLARATION.finditer(clean)]
    found += [(m, m[1], "function", None) for m in ARROW.finditer(clean)]
    for m, name, kind, bases in sorted(found, key=lambda x: x[0].start()):
        if not name or name in NOT_CALLED:
            continue
        at = clean.find("{", m.end() - 1 if clean[m.end() - 1] == "{" else m.end())
        if at < 0 or ";" in clean[m.end() : at]:
            continue
        depth, end = 0, at
        while end < len(clean):
            depth += {"{": 1, "}": -1}.get(clean[end], 0)
            end += 1
            if not depth:
                break
        out.append((name, kind, m.start(), end, bases))
    return out


def extract_braces(path: str, text: str) -> list[dict]:
    """As extract_python, for languages of declarations and braces."""
    module, spans, clean = stem_id(path), brace_spans(text), blank_strings(text)
    out = [_row(row="node", id=module, label=path, kind="module", source_file=path, line=1)]
    line = lambda at: text.count("\n", 0, at) + 1

    def holder(at: int) -> tuple | None:
        return max((s for s in spans if s[2] < at < s[3]), key=lambda s: s[2], default=None)

    ids = {}
    for s in sorted(spans, key=lambda s: s[2]):
        up = holder(s[2])
        owner, names = ids[up] if up else (module, ())
        ids[s] = ident, _ = stem_id(path, *names, s[0]), (*names, s[0])
        method = up is not None and up[1] in ("class", "interface") and s[1] == "function"
        out.append(_row(row="node", id=ident, label=s[0], kind="method" if method else s[1], source_file=path, line=line(s[2])))
        out.append(_row(row="edge", source=owner, target=ident, relation="method" if method else "contains", source_file=path, line=line(s[2])))
        for base in re.findall(r"\w+", s[4] or ""):
            out.append(_row(row="edge", source=ident, target=stem_id(base), relation="extends", source_file=path, line=line(s[2])))
    for m in CALL.finditer(clean):
        if m[2] in NOT_CALLED or any(s[2] <= m.start() < clean.find("{", s[2]) for s in spans):
            continue
        up = holder(m.start())
        out.append(_row(row="call", callee=m[2], receiver=m[1], source=ids[up][0] if up else module, source_file=path, line=line(m.start())))
    return out


def extract_yaml(path: str, text: str) -> list[dict]:
    """A config node; of compose files its services with what they deploy and depend on; of CI files its jobs. Tabs in the indent are an error."""
    module = stem_id(path)
    if re.search(r"(?m)^ *\t", text):
        return [_row(row="error", label="tab in the indent", source_file=path)]
    out = [_row(row="node", id=module, label=path, kind="config", source_file=path, line=1)]
    section, service, inner, depends = None, None, None, False
    for n, raw in enumerate(text.split("\n"), 1):
        body = re.sub(r"\s+#.*$|^#.*$", "", raw).rstrip()
        if not body.strip():
            continue
        indent, key = len(body) - len(body.lstrip()), re.match(r"\s*([\w.\-]+)\s*:\s*(.*)$", body)
        if indent == 0:
            section, service = key[1] if key else None, None
        elif section in ("services", "jobs") and key and (service is None or indent <= inner):
            inner, service, depends = indent, stem_id(path, key[1]), False
            kind = "service" if section == "services" else "deployment"
            out.append(_row(row="node", id=service, label=key[1], kind=kind, source_file=path, line=n))
            out.append(_row(row="edge", source=module, target=service, relation="configures", source_file=path, line=n))
        elif service and key and key[1] == "image" and key[2]:
            out.append(_row(row="edge", source=service, target=stem_id("image", key[2].strip("\"'")), relation="deploys", source_file=path, line=n))
        elif service and key and key[1] in ("build", "context") and key[2]:
            out.append(_row(row="edge", source=service, target=stem_id(key[2].strip("\"'")), relation="reads", source_file=path, line=n))
        elif service and key and key[1] in ("depends_on", "needs"):
            depends = True
            for name in re.findall(r"[\w.\-]+", key[2]):
                out.append(_row(row="edge", source=service, target=stem_id(path, name), relation="consumes", source_file=path, line=n))
        elif service and depends and (item := re.match(r"\s*-\s*([\w.\-]+)$", body)):
            out.append(_row(row="edge", source=service, target=stem_id(path, item[1]), relation="consumes", source_file=path, line=n))
        elif key:
            depends = False
    return out


EXTRACTORS = {"py": extract_python, "ts": extract_braces, "js": extract_braces, "java": extract_braces, "cs": extract_braces, "go": extract_braces, "c": extract_braces, "cpp": extract_braces, "rust": extract_braces, "php": extract_braces, "yaml": extract_yaml}


def extract(files: DataFrame) -> DataFrame:
    """Rows of nodes, edges, calls, imports and errors of files (path, lang, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, lang, text in zip(b["path"], b["lang"], b["content"], strict=True) if lang in EXTRACTORS for r in EXTRACTORS[lang](path, text or "")]
            out = pd.DataFrame(rows, columns=COLUMNS)
            out["line"] = out["line"].astype("Int32")
            yield out

    return files.select("path", "lang", "content").mapInPandas(run, ROWS)


def spans_of(lang: str, text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of a file's functions, in characters; none of Python that does not parse."""
    if lang != "py":
        return [(s[0], s[2], s[3]) for s in brace_spans(text) if s[1] == "function"]
    try:
        found = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    except (SyntaxError, ValueError):
        return []
    starts = [0, *accumulate(len(x) for x in text.splitlines(keepends=True))]
    return [(n.name, starts[n.lineno - 1], starts[n.end_lineno]) for n in found]


def function_spans(files: DataFrame) -> DataFrame:
    """(path, name, first, last): spans of the functions of files, in characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *s) for path, lang, text in zip(b["path"], b["lang"], b["content"], strict=True) for s in spans_of(lang, text or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "first", "last"])

    return files.select("path", "lang", "content").mapInPandas(run, "path string, name string, first long, last long")


def use_sites(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, file, module, names, label): the functions of files (repo, file, lang, content) that use names of their imports.

    A use is the name as a whole word, and belongs to the innermost function around it; uses
    outside of functions, as in the import itself, belong to none.
    """
    wanted = imports.where(F.size("names") > 0).groupBy("repo", "file").agg(F.collect_set(F.struct("module", "names")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, file, lang, text, found in zip(b["repo"], b["file"], b["lang"], b["content"], b["wanted"], strict=True):
                spans = spans_of(lang, text)
                for x in found:
                    uses = [m.start() for name in x["names"] for m in re.finditer(rf"\b{re.escape(name)}\b", text)]
                    around = [max((s for s in spans if s[1] <= at < s[2]), key=lambda s: s[1], default=None) for at in uses]
                    rows += [(repo, file, x["module"], list(x["names"]), label) for label in sorted({s[0] for s in around if s})]
            yield pd.DataFrame(rows, columns=["repo", "file", "module", "names", "label"])

    rows = files.where("content is not null").join(wanted, ["repo", "file"]).select("repo", "file", "lang", "content", "wanted")
    return rows.mapInPandas(run, "repo string, file string, module string, names array<string>, label string")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (path, at, ...) with the innermost span (path, name, first, last) around each, if any.

    Ranges are compared within a path only; the tightest wins, then the later start, then name.
    A span is cut into aligned blocks of 2^level lines, two a level at most. Each block keeps its
    best span, and a point looks at the one block of each level that it lies in, so that no point
    meets all spans of its path. Rows grow by the levels after Spark has estimated them by their
    files, so the joins are told to sort: else a side of many times its estimate is broadcast.
    """
    best, blocks = F.struct((F.col("last") - F.col("first")).alias("size"), (-F.col("first")).alias("start"), "name"), []
    spans = spans.select("path", "name", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).where("first <= last")
    longest = spans.agg(F.max(F.col("last").cast("decimal(38,0)") - F.col("first"))).first()[0]
    for level in range(int((longest or 0) + 1).bit_length()):
        low = F.lit((1 << level) - 1)
        a = F.shiftright("first", level) + (F.col("first").bitwiseAND(low) != 0).cast("int")  # the first block that begins in the span
        b = F.shiftright("last", level) - (F.col("last").bitwiseAND(low) != low).cast("int")  # the last one that ends in it
        odd, even, some = a.bitwiseAND(F.lit(1)) == 1, b.bitwiseAND(F.lit(1)) == 0, a <= b  # those that no block of the next level holds
        blocks += [F.when(some & odd, F.struct(F.lit(level).alias("level"), a.alias("block"))), F.when(some & even, F.struct(F.lit(level).alias("level"), b.alias("block")))]
    if not blocks:
        return points.withColumn("name", F.lit(None).cast(spans.schema["name"].dataType))
    held = spans.select("path", best.alias("s"), F.explode(F.array_compact(F.array(*blocks))).alias("b")).groupBy("path", "b.level", "b.block").agg(F.min("s").alias("s"))
    lines = points.select("path", "at").where("path is not null and at is not null").distinct()
    inside = lines.select("path", "at", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(F.col("at").cast("long"), i).alias("block")) for i in range(len(blocks) // 2)])).alias("b"))
    inner = inside.select("path", "at", "b.*").join(held.hint("merge"), ["path", "level", "block"]).groupBy("path", "at").agg(F.min("s").alias("s"))
    return points.join(inner.select("path", "at", F.col("s.name").alias("name")).hint("merge"), ["path", "at"], "left").select(*points.columns, "name")


def symbol_graph(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """calls edges of a symbol index: references (path, at, symbol) to definitions (path, symbol, first, last) from the innermost definition around."""
    around = enclosing(references, definitions.withColumnRenamed("symbol", "name"))
    known = definitions.select("symbol").distinct().hint("merge")
    return around.where("name is not null and name <> symbol").join(known, "symbol", "left_semi").select(F.col("name").alias("source"), F.col("symbol").alias("target"), F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), "path", "at").distinct()
