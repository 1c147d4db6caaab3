"""Ranked retrieval: term-scored sub-graphs, note search in substring and full-text mode, snippets, topics."""

from __future__ import annotations

import re
import unicodedata

import regex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.identity import WORD_END, normalize_label, split_identifier
from weftline.operators.traversal import Graph, induced, neighbourhood

TITLE_WEIGHT, K1, B = 5.0, 1.2, 0.75


def _normal(text: str) -> str:
    return re.sub(r"[\W_]+", "_", unicodedata.normalize("NFKC", text).lower()).strip("_")


def _parts(word: str) -> list[str]:
    return [x.lower() for x in regex.split(WORD_END, unicodedata.normalize("NFKC", word), flags=regex.V1) if x]


def question_terms(question: str) -> list[str]:
    """Distinct terms longer than one character: words, their normal forms and their identifier parts."""
    out: list[str] = []
    for word in regex.split(r"[^\p{L}\p{N}]+", question):
        if len(word) > 1:
            out += [_normal(word), *(p for p in _parts(word) if len(p) > 1)]
    return list(dict.fromkeys(x for x in out if x))


def node_scores(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """nodes with a positive score: a label equal to a term 100, else a word of the identifier 12, else its beginning 10, else inside 3; 1 more for the file."""
    label, score = F.col("_n.label"), F.lit(0)
    for t in terms:
        hit = F.when(label == t, 100).when(F.array_contains("_n.words", t), 12).when(F.startswith(label, F.lit(t)), 10).when(F.contains(label, F.lit(t)), 3).otherwise(0)
        score = score + hit + F.when(F.contains(F.col("_n.file"), F.lit(t)), 1).otherwise(0)
    forms = F.struct(normalize_label(F.col("label")).alias("label"), split_identifier(F.col("label")).alias("words"), normalize_label(F.col("source_file")).alias("file"))
    rows = nodes.withColumn("_n", F.explode(F.array(forms)))  # else the optimizer repeats the forms in every comparison
    rows = rows.withColumn("_score", F.explode(F.array(score.cast("long")))).where("_score > 0")
    return rows.drop("_n").withColumnRenamed("_score", "score")


def seeds_of(scored: DataFrame, n: int = 3) -> DataFrame:
    """(id, rank) of the n best, ties by id."""
    top = scored.select("id", "score").orderBy(F.desc("score"), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # n rows


def query_graph(g: Graph, question: str, depth: int = 2, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
    """(visited, edges) around the nodes that answer the question best."""
    seen = neighbourhood(g, seeds_of(node_scores(g.nodes, question_terms(question))), depth, max_nodes)
    return seen.join(g.nodes, "id", "left_semi"), induced(g.edges, F.broadcast(seen.select("id")))


def search_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def prefix_tokens(query: str) -> list[str]:
    """For tokens of 4 characters or more: their first 60 % (4 at least), and first 4."""
    out: list[str] = []
    for t in search_tokens(query):
        if len(t) >= 4:
            out += [t[: max(4, int(len(t) * 0.6))], t[:4]]
    return list(dict.fromkeys(out))


def live(observations: DataFrame, project: str | None = None, scope: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows that nothing supersedes, of the given project, scope and type."""
    rows = observations.where("superseded_by is null")
    for column, value in (("project_key", project), ("scope", scope), ("type", kind)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return rows


def band(query: str) -> Column:
    """0 for the topic itself, 1 if the title holds the query, 2 if the content does, else 3."""
    q, topic = query.strip().lower(), F.lower(F.coalesce("topic_key", F.lit("")))
    exact = topic == "_".join(q.split())
    return F.when(exact, 0).when(F.contains(F.lower("title"), F.lit(q)), 1).when(F.contains(F.lower("content"), F.lit(q)), 2).otherwise(3)


def _matches(rows: DataFrame, tokens: list[str]) -> DataFrame:
    title, content = F.lower("title"), F.lower("content")
    any_hit = F.lit(False)
    for t in tokens:
        any_hit = any_hit | F.contains(title, F.lit(t)) | F.contains(content, F.lit(t))
    return rows.where(any_hit)


def like_search(observations: DataFrame, query: str, limit: int = 10, **only: str | None) -> DataFrame:
    """(id, title, type, topic_key, snippet, score, band, updated_at): live rows with any token, by band and recency.

    score is the number of tokens in the title. An empty query gives the most recent rows with
    score 0. Where nothing matches, beginnings of longer tokens are tried.
    """
    rows, tokens = live(observations, **only), search_tokens(query)
    cols = ["id", "title", "type", "topic_key", "snippet", "score", "band", "updated_at"]
    if not tokens:
        out = rows.withColumns({"score": F.lit(0).cast("long"), "band": F.lit(3), "snippet": snippet(F.col("content"), [])})
        return out.orderBy(F.desc("updated_at"), "id").limit(limit).select(*cols)
    found = _matches(rows, tokens)
    if found.isEmpty() and prefix_tokens(query):
        tokens = prefix_tokens(query)
        found = _matches(rows, tokens)
    score = sum((F.contains(F.lower("title"), F.lit(t)).cast("long") for t in tokens), F.lit(0).cast("long"))
    top = found.withColumns({"score": score, "band": band(query)}).orderBy("band", F.desc("updated_at"), "id").limit(limit)
    return top.withColumn("snippet", snippet(F.col("content"), tokens)).select(*cols)


def snippet(content: Column, tokens: list[str], around: int = 40, whole: int = 160) -> Column:
    """The surroundings of the earliest token, that one in brackets wherever it occurs; the beginning where none does."""
    if not tokens:
        return F.when(F.length(content) > whole, F.concat(F.substring(content, 1, whole), F.lit(" …"))).otherwise(content)
    low = F.lower(content)
    spots = [F.when(F.locate(t, low) > 0, F.struct(F.locate(t, low).alias("at"), F.lit(i).alias("i"), F.lit(len(t)).alias("len"))) for i, t in enumerate(tokens)]
    first = F.array_min(F.filter(F.array(*spots), lambda x: x.isNotNull()))
    start = F.greatest(first["at"] - around, F.lit(1))
    end = F.least(first["at"] + first["len"] - 1 + around, F.length(content))
    body = F.substring(content, start, end - start + 1)
    marked = body
    for i, t in enumerate(tokens):
        marked = F.when(first["i"] == i, F.regexp_replace(body, f"(?iu)({re.escape(t)})", "[$1]")).otherwise(marked)
    cut_off = F.concat(F.when(start > 1, " … ").otherwise(""), marked, F.when(end < F.length(content), " … ").otherwise(""))
    return F.when(first.isNotNull(), cut_off).otherwise(snippet(content, []))


def porter(word: str) -> str:
    """Stem of a lower-cased English word, after the algorithm published by M. F. Porter in 1980."""
    if len(word) < 3 or not word.isascii():
        return word
    vowel = lambda w, i: w[i] in "aeiou" or w[i] == "y" and i > 0 and not vowel(w, i - 1)
    measure = lambda w: sum(not vowel(w, i) and i > 0 and vowel(w, i - 1) for i in range(len(w)))
    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"

    def replaced(w: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
        for end, new in rules:
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + new if measure(stem) > least else w
        return w

    w = word
    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                w = w + "e" if w.endswith(("at", "bl", "iz")) else w[:-1] if double(w) and w[-1] not in "lsz" else w + "e" if measure(w) == 1 and cvc(w) else w
                break
    w = w[:-1] + "i" if w.endswith("y") and has_vowel(w[:-1]) else w
    # The suffix tables of the published algorithm.
    w = replaced(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = replaced(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            w = stem if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stems(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [porter(x) for x in re.split(r"[\W_]+", plain) if x]


def _stems(s: pd.Series) -> pd.Series:
    return s.map(lambda x: stems(x) if x else [])


def stemmed(c: str) -> Column:
    return F.pandas_udf(_stems, "array<string>")(c)


def topic_key(kind: str, title: str) -> str:
    return f"{kind}/{_normal(title).replace('_', '-')}"


def suggest_topics(observations: DataFrame, kind: str, title: str, n: int = 3, **only: str | None) -> DataFrame:
    """(topic_key, score): the n live topics nearest to the suggested one, by Jaccard over their parts."""
    own = [x for x in re.split("[-/]", topic_key(kind, title)) if x]
    topics = live(observations, **only).where("topic_key is not null").select("topic_key").distinct()
    parts, mine = F.filter(F.split("topic_key", "[-/]"), lambda x: x != ""), F.array(*[F.lit(x) for x in own])
    score = F.size(F.array_intersect(parts, mine)) / F.size(F.array_union(parts, mine))
    return topics.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), "topic_key").limit(n)


def first_line(content: Column, most: int = 200) -> Column:
    """The first line that is not blank; beyond `most` characters cut at its last blank there and marked."""
    line = F.coalesce(F.get(F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: x.rlike(r"\S")), F.lit(0)), F.lit(""))
    head = F.substring(line, 1, most)
    words = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.when(words == "", head).otherwise(words), F.lit("…")))


CONTEXT_HEAD = "## Project memory"


def active_context(observations: DataFrame, rows: int = 10, budget: int = 4000, **only: str | None) -> DataFrame:
    """(pos, id, line): the most recent live rows as entries under CONTEXT_HEAD, up to the first that would exceed the budget of characters."""
    top = live(observations, **only).orderBy(F.desc("updated_at"), "id").limit(rows)
    line = F.concat(F.lit("- "), "title", F.lit(" ["), "type", F.lit("]\n  "), first_line(F.col("content")))
    order = Window.orderBy(F.desc("updated_at"), "id")  # `rows` rows
    out = top.select("id", line.alias("line"), F.row_number().over(order).alias("pos"), F.sum(F.length(line) + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return out.where(F.col("used") + len(CONTEXT_HEAD) + 1 <= budget).select("pos", "id", "line")


def context_text(entries: DataFrame, graph: tuple[int, int] | None = None, fresh: bool | None = None, refresh: str = "") -> str:
    """The active context as text: entries of active_context, the graph's size and whether it is fresh, each a paragraph."""
    lines = [r["line"] for r in entries.orderBy("pos").collect()]  # within the budget
    parts = ["\n".join([CONTEXT_HEAD, *lines]) if lines else CONTEXT_HEAD + "\n(no observations yet)"]
    if graph:
        parts.append(f"graph: {graph[0]} nodes, {graph[1]} edges" + {True: " (fresh)", False: " (stale)", None: ""}[fresh])
    if fresh is False or not graph:
        parts.append(refresh)
    return "\n\n".join(p for p in parts if p)


SPAN, PATH, IDENT = r"`([^`\n]+)`", r"^[\w.@-]+(/[\w.@-]+)+$|^[\w-]+\.\w{1,5}$", r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*(\(\))?$"


def candidate_labels(rows: DataFrame, content: str = "content", id_col: str = "id") -> DataFrame:
    """(id, pos, label) of code spans that look like `path:symbol()`, a path or an identifier."""
    spans = rows.select(id_col, F.posexplode(F.regexp_extract_all(F.col(content), F.lit(SPAN), F.lit(1))).alias("pos", "span"))
    symbol = F.regexp_extract("span", r"^[^\s:]+:([A-Za-z_$][\w$]*)(\(\))?$", 1)
    last = F.regexp_replace(F.element_at(F.split("span", r"\."), -1), r"\(\)$", "")
    label = F.when(symbol != "", symbol).when(F.col("span").rlike(PATH), F.col("span")).when(F.col("span").rlike(IDENT), last)
    return spans.select(id_col, "pos", label.alias("label")).where("label is not null")
