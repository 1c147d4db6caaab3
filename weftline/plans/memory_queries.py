"""Queries over notes, anchors, sessions, repositories, sources and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline import schemas
from weftline.operators import memory as m
from weftline.operators import multirepo, postings, resolve, retrieval
from weftline.operators.traversal import Graph
from weftline.plans.lineage import cut, shared_dir
from weftline.plans.registry import plain, query
from weftline.plans.workload import Workload, key, millis, with_tables
from weftline.sources import extract, files, store
from weftline.streaming import outbox

S, O, A = with_tables("saves"), with_tables("obs"), with_tables("anchors")
OA = with_tables("obs", "anchors")


def obs(w: Workload):
    return m.evolve(w.saves)


# --- notes and their versions


@query("M1_fresh_ids", S + "SELECT id, project_key || ':' || type || ':' || topic_key || ':' || ts || ':' || 'u' || ts AS made FROM saves")
def _(w):
    return w.saves.select("id", m.observation_id(F.col("project_key"), F.col("type"), F.col("topic_key"), F.col("ts"), F.concat(F.lit("u"), F.col("ts").cast("string"))).alias("made"))


@query("M2_topic_evolve", O + "SELECT id, project_key, topic_key, title, created_at, updated_at, revision, superseded_by FROM obs")
def _(w):
    return obs(w).select("id", "project_key", "topic_key", "title", "created_at", "updated_at", "revision", "superseded_by")


@query("M2_topic_evolve_in_batches", O + "SELECT id, title, created_at, updated_at, revision, superseded_by FROM obs")
def _(w):
    first, rest = w.saves.where("ts % 1000 < 120"), w.saves.where("ts % 1000 >= 120 and ts < 1000")
    if w.saves.where("ts >= 1000").limit(1).count():  # larger tables come in two batches by ts
        first, rest = w.saves.where("ts < 1000"), w.saves.where("ts >= 1000")
    return m.save(m.evolve(first), rest).select("id", "title", "created_at", "updated_at", "revision", "superseded_by")


@query("M3_update", O + "SELECT id, CASE WHEN superseded_by IS NULL AND revision % 2 = 0 THEN 'patched' ELSE title END AS title, type, CASE WHEN superseded_by IS NULL AND revision % 2 = 0 THEN 999999 ELSE updated_at END AS updated_at, revision FROM obs")
def _(w):
    rows = obs(w)
    none = F.lit(None).cast("string")
    patch = rows.where("revision % 2 = 0").select("id", F.lit("patched").alias("title"), none.alias("content"), none.alias("type"), none.alias("topic_key"))
    return m.update(rows, patch, F.lit(999999).cast("long"))[0].select("id", "title", "type", "updated_at", "revision")


@query("M3_update_errors", O + "SELECT id, 'superseded' AS error FROM obs WHERE superseded_by IS NOT NULL UNION ALL SELECT 'obs:none', 'not-found'")
def _(w):
    rows = obs(w)
    patch = rows.select("id").unionByName(w.spark.createDataFrame([("obs:none",)], "id string"))
    for c in ("title", "content", "type", "topic_key"):
        patch = patch.withColumn(c, F.lit(None).cast("string"))
    return m.update(rows, patch, F.lit(1).cast("long"))[1]


@query("M4_atomic_batch", S + "SELECT ts AS index, false AS ok, CASE WHEN ts % 50 = 0 THEN 'bad' ELSE 'rolled-back' END AS error FROM saves")
def _(w):
    return m.batch_results(w.saves.select(F.col("ts").alias("index"), F.when(F.col("ts") % 50 == 0, "bad").alias("error")), True)


@query("M4_loose_batch", S + "SELECT ts AS index, ts % 50 <> 0 AS ok, CASE WHEN ts % 50 = 0 THEN 'bad' END AS error FROM saves")
def _(w):
    return m.batch_results(w.saves.select(F.col("ts").alias("index"), F.when(F.col("ts") % 50 == 0, "bad").alias("error")), False)


@query("M5_get_batch", S + "SELECT requested, saves.title FROM (VALUES ('#obs:3', 'obs:3'), ('obs:4', 'obs:4'), ('obs:none', 'obs:none')) v(requested, id) LEFT JOIN saves USING (id)")
def _(w):
    wanted = w.spark.createDataFrame([("#obs:3",), ("obs:4",), ("obs:none",)], "id string")
    return m.get_batch(w.saves, wanted).select("requested", "title")


@query("M6_sessions", with_tables("sessions") + "SELECT id, project_key, title, summary, started_at, ended_at FROM sessions")
def _(w):
    return w.sessions


@query("M6_end_sessions", with_tables("sessions") + "SELECT id, CASE WHEN started_at % 2 = 0 THEN 'done' ELSE summary END AS summary, started_at, CASE WHEN started_at % 2 = 0 THEN 77 ELSE ended_at END AS ended_at FROM sessions UNION ALL SELECT 'session:new', 'done', 77, 77")
def _(w):
    known = w.sessions.withColumn("scope", F.lit("project"))
    none = F.lit(None).cast("string")
    ended = known.where("started_at % 2 = 0").select("id").unionByName(w.spark.createDataFrame([("session:new",)], "id string"))
    ended = ended.select("id", F.lit("p9").alias("project_key"), F.lit("project").alias("scope"), none.alias("title"), F.lit("done").alias("summary"), F.lit(77).cast("long").alias("ts"))
    return m.end_sessions(known, ended).select("id", "summary", "started_at", "ended_at")


def _labels(w):
    return w.saves.select(F.col("id").alias("observation_id"), F.col("ts")).join(w.parts.where("p_partkey < 50").select(F.col("p_partkey").alias("ts"), "label"), "ts").select("observation_id", "label")


NODE_NAME = r"trim(regexp_replace(lower(label), '[^\p{L}\p{N}]+', '_', 'g'), '_')"


@query("M7_anchor_insert", with_tables("saves", "hashes", "nodes") + f", l AS (SELECT s.id AS observation_id, parts.label, {NODE_NAME} AS name FROM saves s JOIN parts ON p_partkey = ts AND p_partkey < 50), n AS (SELECT nodes.id, nodes.source_file, {NODE_NAME} AS name FROM nodes) SELECT observation_id, n.id AS node_id, label AS anchor_label, n.source_file AS anchor_file, hash AS anchor_hash FROM l JOIN n USING (name) LEFT JOIN hashes ON hashes.id = n.id")
def _(w):
    return m.resolve_anchors(_labels(w), w.nodes, w.file_hashes)


@query("J9_anchor_labels", with_tables("saves", "nodes", "parts") + f", l AS (SELECT DISTINCT {NODE_NAME} AS name FROM saves s JOIN parts ON p_partkey = ts AND p_partkey < 50) SELECT name, count(*) AS nodes FROM l JOIN (SELECT {NODE_NAME} AS name FROM nodes) n USING (name) GROUP BY name")
def _(w):
    from weftline.functions.identity import normalize_label

    names = _labels(w).select(normalize_label(F.col("label")).alias("name")).distinct()
    return names.join(w.nodes.select(normalize_label(F.col("label")).alias("name")), "name").groupBy("name").agg(F.count("*").alias("nodes"))


@query("M8_add_anchors", A + "SELECT observation_id, node_id, role FROM anchors WHERE created_at % 3 = 0")
def _(w):
    return m.add_anchors(w.anchors.where("created_at % 3 <> 0"), w.anchors.unionByName(w.anchors)).select("observation_id", "node_id", "role")


IMPORT_SQL = O + """, items AS (SELECT * REPLACE (id || CASE WHEN revision % 3 = 0 THEN 'x' ELSE '' END AS id, updated_at + 5 AS updated_at, 'en' AS project_key) FROM obs WHERE project_key = 'en'),
mine AS (SELECT * FROM obs WHERE project_key = 'en'),
j AS (SELECT coalesce(m.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'kept' WHEN m.id IS NULL THEN 'inserted' WHEN (i.revision, i.updated_at) > (m.revision, m.updated_at) THEN 'updated' ELSE 'skipped' END AS action,
    coalesce(i.revision, m.revision) AS revision, coalesce(i.updated_at, m.updated_at) AS updated_at, coalesce(m.topic_key, i.topic_key) AS topic_key, coalesce(m.superseded_by, i.superseded_by) AS superseded_by FROM mine m FULL JOIN items i USING (id)),
k AS (SELECT *, first_value(id) OVER (PARTITION BY topic_key, superseded_by IS NULL ORDER BY revision DESC, updated_at DESC, id DESC) AS w FROM j)
"""  # fmt: skip


def _import(w):
    mine = obs(w).where("project_key = 'en'")
    items = mine.withColumns({"id": F.when(F.col("revision") % 3 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")), "updated_at": F.col("updated_at") + 5, "project_key": F.lit("other")})
    return m.import_merge(mine, items, "en")


@query("M9_import_merge", IMPORT_SQL + "SELECT id, action, revision, updated_at, CASE WHEN superseded_by IS NULL AND w <> id THEN w ELSE superseded_by END AS superseded_by FROM k")
def _(w):
    return _import(w).select("id", "action", "revision", "updated_at", "superseded_by")


@query("A16_import_report", IMPORT_SQL + "SELECT action, count(*) AS n FROM k GROUP BY action")
def _(w):
    return _import(w).groupBy("action").agg(F.count("*").alias("n"))


@query("M10_sync", IMPORT_SQL + "SELECT id, 1 AS schema_version FROM k")
def _(w):
    none = w.anchors.where("false")
    return m.export(_import(w), none).select("id", F.col("schemaVersion").alias("schema_version"))


@query("J3_merge_collisions", O + "SELECT a.id AS from_id, b.id AS into_id FROM obs a JOIN obs b ON a.scope = b.scope AND a.topic_key = b.topic_key WHERE a.project_key = 'fr' AND b.project_key = 'en' AND a.superseded_by IS NULL AND b.superseded_by IS NULL")
def _(w):
    return m.merge_collisions(obs(w), "fr", "en")


@query("M11_merge_project", O + ", hit AS (SELECT a.id, min(b.id) AS into_id FROM obs a JOIN obs b ON a.scope = b.scope AND a.topic_key = b.topic_key WHERE a.project_key = 'fr' AND b.project_key = 'en' AND a.superseded_by IS NULL AND b.superseded_by IS NULL GROUP BY a.id) SELECT id, CASE WHEN project_key = 'fr' AND superseded_by IS NULL AND into_id IS NULL THEN 'en' ELSE project_key END AS project_key, coalesce(superseded_by, into_id) AS superseded_by FROM obs LEFT JOIN hit USING (id)")
def _(w):
    return m.merge_project(obs(w), "fr", "en").select("id", "project_key", "superseded_by")


@query("M12_federation", O + ", r AS (SELECT id, revision AS score, CASE project_key WHEN 'en' THEN 1 ELSE 2 END AS store_rank FROM obs WHERE superseded_by IS NULL UNION ALL SELECT id, revision + 1, 3 FROM obs WHERE superseded_by IS NULL) SELECT id, score, store_rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY store_rank) AS rn FROM r) WHERE rn = 1 ORDER BY score DESC, store_rank, id LIMIT 10")
def _(w):
    live = obs(w).where("superseded_by is null")
    host = live.select("id", F.col("revision").alias("score"), F.when(F.col("project_key") == "en", 1).otherwise(2).alias("store_rank"))
    return m.federated(host.unionByName(live.select("id", (F.col("revision") + 1).alias("score"), F.lit(3).alias("store_rank"))))


@query("M13_recent_context", O + "SELECT id, updated_at FROM obs WHERE superseded_by IS NULL ORDER BY updated_at DESC, id LIMIT 20")
def _(w):
    return m.recent(obs(w)).select("id", "updated_at")


@query("W6_recent_sessions", with_tables("sessions") + "SELECT id, started_at FROM sessions ORDER BY started_at DESC, id LIMIT 5")
def _(w):
    return m.recent_sessions(w.sessions).select("id", "started_at")


@query("J16_orphan_counts", O + "SELECT project_key, count(*) AS n FROM obs WHERE superseded_by IS NULL AND project_key IN ('en', 'es', 'xx') GROUP BY 1")
def _(w):
    return m.orphan_counts(obs(w), ["en", "es", "xx"])


@query("J2_anchored_observations", OA + "SELECT id, updated_at FROM obs WHERE superseded_by IS NULL AND id IN (SELECT observation_id FROM anchors WHERE node_id = (SELECT min(node_id) FROM anchors a JOIN obs o ON o.id = a.observation_id AND o.superseded_by IS NULL)) ORDER BY updated_at DESC, id LIMIT 10")
def _(w):
    rows = obs(w)
    node = w.anchors.join(rows.where("superseded_by is null").select(F.col("id").alias("observation_id")), "observation_id", "left_semi").agg(F.min("node_id")).first()[0]
    return m.anchored(w.anchors, rows, node).select("id", "updated_at")


@query("K8_export", OA + "SELECT id, revision, coalesce(n, 0) AS anchors, first AS first_node FROM obs LEFT JOIN (SELECT observation_id AS id, count(*) AS n, min(node_id) AS first FROM anchors GROUP BY 1) USING (id)")
def _(w):
    return m.export(obs(w), w.anchors).select("id", "revision", F.size("anchors").cast("long").alias("anchors"), F.get("anchors", F.lit(0))["node_id"].alias("first_node"))


@query("P7_optional_filters", O + "SELECT id FROM obs WHERE superseded_by IS NULL AND type = 'decision' AND project_key = 'en'")
def _(w):
    return retrieval.live(obs(w), project="en", kind="decision").select("id")


@query("P8_live_rows", O + "SELECT id FROM obs WHERE superseded_by IS NULL")
def _(w):
    return retrieval.live(obs(w)).select("id")


@query("A15_topics", O + "SELECT DISTINCT topic_key FROM obs WHERE superseded_by IS NULL AND topic_key IS NOT NULL")
def _(w):
    return retrieval.live(obs(w)).where("topic_key is not null").select("topic_key").distinct()


# --- search


def like_sql(tokens: list[str], query: str, limit: int = 10) -> str:
    hit = " OR ".join(f"contains(lower(title), '{t}') OR contains(lower(content), '{t}')" for t in tokens)
    score = " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN 1 ELSE 0 END" for t in tokens)
    band = f"CASE WHEN lower(coalesce(topic_key, '')) = '{query.lower().replace(' ', '_')}' THEN 0 WHEN contains(lower(title), '{query.lower()}') THEN 1 WHEN contains(lower(content), '{query.lower()}') THEN 2 ELSE 3 END"
    return O + f"SELECT id, CAST({score} AS BIGINT) AS score, {band} AS band, updated_at FROM obs WHERE superseded_by IS NULL AND ({hit}) ORDER BY band, updated_at DESC, id LIMIT {limit}"


@query("T5_like_search", like_sql(["the", "anst"], "the anst"))
def _(w):
    return retrieval.like_search(obs(w), "the anst").select("id", "score", "band", "updated_at")


@query("W8_search_order", like_sql(["la"], "la", 30))
def _(w):
    return retrieval.like_search(obs(w), "la", 30).select("id", "score", "band", "updated_at")


@query("T6_prefix_fallback", like_sql(["thes", "thes"], "thesqqq").replace("contains(lower(title), 'thesqqq')", "false").replace("contains(lower(content), 'thesqqq')", "false").replace("THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'thes') THEN 1 ELSE 0 END", "THEN 1 ELSE 0 END"))
def _(w):
    return retrieval.like_search(obs(w), "thesqqq").select("id", "score", "band", "updated_at")


@query("T4_prefix_tokens", "SELECT * FROM (VALUES ('resol'), ('reso'), ('clas'), ('node')) v(token)")
def _(w):
    return w.spark.createDataFrame([(x,) for x in retrieval.prefix_tokens("resolving class nodes of")], "token string")


@query("P7_empty_search", O + "SELECT id, CAST(0 AS BIGINT) AS score FROM obs WHERE superseded_by IS NULL ORDER BY updated_at DESC, id LIMIT 10")
def _(w):
    return retrieval.like_search(obs(w), " ").select("id", "score")


@query("T3_bm25_search")
def _(w):
    return postings.search(obs(w), "the standing of others").select("id", "score", "band", "updated_at")


def chained(w: Workload):
    """Saves of which every three make a topic."""
    return w.saves.withColumn("topic_key", F.concat(F.lit("doc/"), F.floor(F.col("ts") / 3).cast("string")))


def indexed(w: Workload):
    """An index of words over all notes, a third of which came as a second batch; and the notes."""
    rows = chained(w)
    before = cut(m.evolve(rows.where("ts % 3 < 2")))
    after = cut(m.save(before, rows.where("ts % 3 = 2")))
    index = postings.PostingsIndex(w.spark, f"{shared_dir(w.spark)}/{uuid.uuid4().hex}", "words")
    index.update(None, before)
    index.update(before, after)
    return index, after


WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
INDEXED = with_tables("saves") + f""", links AS (
    SELECT *, 'doc/' || (ts // 3) AS topic, row_number() OVER w AS rn, count(*) OVER (PARTITION BY project_key, ts // 3) AS last, first_value(id) OVER w AS live_id
    FROM saves WINDOW w AS (PARTITION BY project_key, ts // 3 ORDER BY ts, id)),
notes AS (SELECT live_id AS id, project_key, topic AS topic_key, title, content, ts AS updated_at FROM links WHERE rn = last),
tok AS (SELECT *, {WORDS.format('title')} AS t, {WORDS.format('content')} AS c FROM notes)"""


def bm25_sql(phrases: list[str], prefix: bool = False) -> str:
    """Okapi BM25 of phrases over tok, by a scan."""

    def times(side: str, phrase: str) -> str:
        tests = [f"starts_with({side}[i + {k}], '{x}')" if prefix else f"{side}[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())]
        return f"len(list_filter(range(1, len({side}) + 1), lambda i: coalesce({' AND '.join(tests)}, false)))"

    f = ", ".join(f"5.0 * {times('t', p)} + {times('c', p)} AS f{i}" for i, p in enumerate(phrases))
    idf = [f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END" for i in range(len(phrases))]
    terms = " + ".join(f"{x} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i, x in enumerate(idf))
    some = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f""", counted AS MATERIALIZED (SELECT *, len(t) + len(c) AS size, {f} FROM tok),
total AS (SELECT count(*) AS n, avg(size) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(phrases)))} FROM counted),
hits AS (SELECT counted.*, round({terms}, 6) AS score FROM counted, total WHERE {some})"""


def best_sql(query: str) -> str:
    return f"""SELECT id, score, CASE WHEN topic_key = '{query.replace(' ', '_')}' THEN 0 WHEN contains(lower(coalesce(title, '')), '{query}') THEN 1 WHEN contains(lower(content), '{query}') THEN 2 ELSE 3 END AS band, updated_at
FROM hits ORDER BY band, score DESC, updated_at DESC, id LIMIT 10"""


@query("T3_index_search", INDEXED + bm25_sql(["of the", "of", "the"]) + best_sql("of the"))
def _(w):
    index, notes = indexed(w)
    return postings.search(notes, "of the", index=index).select("id", "score", "band", "updated_at")


@query("T3_prefix_retry", INDEXED + bm25_sql(["stan"], prefix=True) + best_sql("stanqx"))
def _(w):
    index, notes = indexed(w)
    return postings.search(notes, "stanqx", index=index).select("id", "score", "band", "updated_at")


@query("T3_snippets")
def _(w):
    index, notes = indexed(w)
    return postings.search(notes, "of the", 100, index=index).select("id", "snippet")


@query("T7_snippet", S + r"""SELECT id, CASE WHEN "at" = 0 THEN CASE WHEN length(content) > 160 THEN substr(content, 1, 160) || ' …' ELSE content END ELSE
    CASE WHEN greatest("at" - 40, 1) > 1 THEN ' … ' ELSE '' END || regexp_replace(substr(content, greatest("at" - 40, 1), least("at" + 2 + 40, length(content)) - greatest("at" - 40, 1) + 1), '(the)', '[\1]', 'gi') || CASE WHEN least("at" + 2 + 40, length(content)) < length(content) THEN ' … ' ELSE '' END END AS snippet
FROM (SELECT id, content, instr(lower(content), 'the') AS "at" FROM saves WHERE project_key = 'en')""")
def _(w):
    return w.saves.where("project_key = 'en'").select("id", retrieval.snippet(F.col("content"), ["the"]).alias("snippet"))


@query("T9_index_rows", INDEXED + "SELECT project_key, count(*) AS n, CAST(sum(len(t) + len(c)) AS BIGINT) AS words FROM tok WHERE len(t) + len(c) > 0 GROUP BY 1")
def _(w):
    index, notes = indexed(w)
    rows = index.rows("id", "length").distinct()
    return notes.join(rows, "id").groupBy("project_key").agg(F.count("*").alias("n"), F.sum("length").alias("words"))


@query("T8_stems")
def _(w):
    return w.table("documents").select("doc_id", F.array_join(retrieval.stemmed("text"), " ").alias("stems"))


@query("T10_topic_suggestion", O + "SELECT topic_key, round(1 / 3, 6) AS score FROM (SELECT DISTINCT topic_key FROM obs WHERE superseded_by IS NULL) WHERE topic_key = 'src3'")
def _(w):
    return retrieval.suggest_topics(obs(w), "decision", "Src3 other")


@query("T11_active_context", O + """, top AS (SELECT *, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1] AS one FROM obs WHERE superseded_by IS NULL AND project_key = 'en' ORDER BY updated_at DESC, id LIMIT 10),
entry AS (SELECT id, updated_at, '- ' || title || ' [' || type || ']' || chr(10) || '  ' || CASE WHEN length(coalesce(one, '')) <= 200 THEN coalesce(one, '') WHEN regexp_matches(one[1:200], '. ') THEN regexp_extract(one[1:200], '^(.+) [^ ]*$', 1) || '…' ELSE one[1:200] || '…' END AS line FROM top),
used AS (SELECT *, row_number() OVER w AS pos, 18 + sum(length(line) + 1) OVER w AS used FROM entry WINDOW w AS (ORDER BY updated_at DESC, id))
SELECT CAST(pos AS INTEGER) AS pos, id, line FROM used WHERE used <= 4000""")
def _(w):
    return retrieval.active_context(obs(w), project="en")


@query("W12_budget_prefix", S + "SELECT id, ts FROM (SELECT id, ts, sum(length(title) + 1) OVER (ORDER BY ts DESC, id) AS used FROM saves WHERE ts >= (SELECT max(ts) - 40 FROM saves)) WHERE used <= 500")
def _(w):
    from pyspark.sql.window import Window

    rows = w.saves.orderBy(F.desc("ts"), "id").limit(41)
    used = F.sum(F.length("title") + 1).over(Window.orderBy(F.desc("ts"), "id"))
    return rows.withColumn("used", used).where("used <= 500").select("id", "ts")


SPANS_SQL = "WITH k AS (SELECT p_partkey AS k, 'note:' || p_partkey AS id FROM part), spans AS (SELECT id, k, 0 AS pos, 'p' || k AS label FROM k UNION ALL SELECT id, k, 2, 'part' || k FROM k UNION ALL SELECT id, k, 3, 'P' || k FROM k UNION ALL SELECT id, k, 4, 'src/f' || (k % 97) || '.ts' FROM k)\n"


def _spans(w):
    """A note on every part, with code spans that name a symbol, nothing, a call, a symbol again and a file."""
    k, file = F.col("p_partkey").cast("string"), F.concat(F.lit("src/f"), (F.col("p_partkey") % 97).cast("string"), F.lit(".ts"))
    text = F.concat(F.lit("See `"), file, F.lit(":p"), k, F.lit("()`, not `Order#"), k, F.lit("`; `load.part"), k, F.lit("()` or `P"), k, F.lit("` in `"), file, F.lit("`."))
    return retrieval.candidate_labels(w.table("part").select(F.concat(F.lit("note:"), k).alias("id"), text.alias("content")))


@query("T12_candidate_labels", SPANS_SQL + "SELECT id, pos, label FROM spans")
def _(w):
    return _spans(w)


@query("T13_reanchor", SPANS_SQL + """SELECT id, pos, CASE WHEN pos IN (0, 3) AND k % 3 = 0 AND k % 9 <> 0 THEN 'part:' || k END AS node_id,
    CASE WHEN pos IN (2, 4) OR k % 3 <> 0 THEN 'no-node' WHEN k % 9 = 0 THEN 'ambiguous' WHEN k % 6 = 0 THEN 'present' WHEN pos = 3 THEN 'repeated' ELSE 'minted' END AS outcome FROM spans""")
def _(w):
    k = F.col("p_partkey").cast("string")
    part = w.table("part").select("p_partkey", key("part", "p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "P").otherwise("q"), k).alias("label"))
    twice = part.where("p_partkey % 9 = 0").select("p_partkey", F.concat(F.lit("more:"), k).alias("id"), "label")
    have = part.where("p_partkey % 6 = 0").select(F.concat(F.lit("note:"), k).alias("observation_id"), F.col("id").alias("node_id"))
    return m.reanchor(_spans(w), part.unionByName(twice).select("id", "label"), have).select("id", "pos", "node_id", "outcome")


# --- drift


STATE_SQL = with_tables("anchors", "nodes") + """, st AS (SELECT a.observation_id, a.node_id, CASE WHEN anchor_file IS NULL THEN 'unverified' WHEN n.id IS NULL THEN 'contradicted' WHEN anchor_hash IS NULL OR h.hash IS NULL THEN 'unverified' WHEN anchor_hash <> h.hash THEN 'stale' ELSE 'active' END AS state FROM anchors a LEFT JOIN nodes n ON n.id = a.node_id LEFT JOIN hashes h ON h.id = a.node_id)
"""


def _states(w):
    return m.anchor_states(w.anchors, w.nodes, w.file_hashes)


@query("D1_anchor_states", STATE_SQL + "SELECT * FROM st")
def _(w):
    return _states(w).select("observation_id", "node_id", "state")


@query("J10_anchor_verification", STATE_SQL + "SELECT state, count(*) AS n FROM st GROUP BY state")
def _(w):
    return _states(w).groupBy("state").agg(F.count("*").alias("n"))


MEMORY_SQL = with_tables("saves", "anchors", "nodes") + STATE_SQL[STATE_SQL.index(", st AS") :] + ", ms AS (SELECT id, type, coalesce(state, 'unverified') AS state FROM saves LEFT JOIN (SELECT observation_id AS id, state FROM st) USING (id))\n"
VERDICT = "CASE WHEN state = 'active' THEN 'usable' WHEN type IN ('decision', 'preference') AND state IN ('stale', 'contradicted') THEN 'usable' WHEN type IN ('decision', 'preference') THEN 'warning' WHEN state = 'contradicted' THEN 'do_not_use' ELSE 'warning' END AS verdict, type IN ('decision', 'preference') AND state IN ('stale', 'contradicted') AS check_violation"


@query("D2_memory_states", MEMORY_SQL + "SELECT id, type, state FROM ms")
def _(w):
    return m.memory_states(w.saves, _states(w)).select("id", "type", "state")


@query("A12_worst_state", "SELECT id, CASE WHEN n % 4 = 0 THEN 'contradicted' WHEN n % 2 = 0 THEN 'stale' ELSE 'unverified' END AS state FROM (SELECT 'o' || l_orderkey AS id, bit_or(CASE WHEN l_linenumber >= 3 THEN 4 WHEN l_linenumber = 2 THEN 2 ELSE 1 END) AS b, CASE WHEN max(l_linenumber) >= 3 THEN 4 WHEN max(l_linenumber) = 2 THEN 2 ELSE 1 END AS n FROM lineitem GROUP BY l_orderkey)")
def _(w):
    line = w.table("lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("observation_id"), F.col("l_linenumber").cast("string").alias("node_id"), F.lit("about").alias("role"), F.when(F.col("l_linenumber") >= 3, "contradicted").when(F.col("l_linenumber") == 2, "stale").otherwise("unverified").alias("state"), F.lit("r").alias("reason"))
    ids = line.select(F.col("observation_id").alias("id"), F.lit("bugfix").alias("type")).distinct()
    return m.memory_states(ids, line).select("id", "state")


@query("D3_verdicts", MEMORY_SQL + f"SELECT id, state, {VERDICT} FROM ms")
def _(w):
    return m.verdicts(m.memory_states(w.saves, _states(w))).select("id", "state", "verdict", "check_violation")


HITS = "SELECT id, type, title, content, ts FROM saves WHERE contains(lower(title), 'the') OR contains(lower(content), 'the') ORDER BY ts DESC LIMIT 25"


@query("D4_verified_context", MEMORY_SQL + f"SELECT id, state, {VERDICT} FROM ms WHERE id IN (SELECT id FROM (SELECT id FROM saves WHERE contains(lower(content), 'the') ORDER BY CASE WHEN contains(lower(title), 'the') THEN 1 ELSE 2 END, ts DESC, id LIMIT 25))")
def _(w):
    rows = w.saves.select("*", F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("superseded_by"))
    hits = retrieval.like_search(rows, "the", 25).select("id", "type", F.lit(1).alias("rank"))
    return m.verified_context(F.broadcast(hits), w.anchors, w.nodes, w.file_hashes).select("id", "state", "verdict", "check_violation")


@query("C4_node_memories", MEMORY_SQL + ", pick AS (SELECT min(node_id) AS node_id FROM anchors) SELECT id, state FROM ms WHERE id IN (SELECT observation_id FROM anchors JOIN pick USING (node_id))")
def _(w):
    node = w.anchors.agg(F.min("node_id")).first()[0]
    rows = w.saves.select("*", F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("superseded_by"))
    mine = m.anchored(w.anchors, rows, node, 1_000_000)
    return m.memory_states(mine, _states(w)).select("id", "state")


def _manifest(w):
    return w.table("pages").select(F.parse_url("url", F.lit("PATH")).alias("path"), F.lit(100.0).alias("mtime"), F.sha2("html", 256).alias("hash"), F.col("page_id").alias("ord")).dropDuplicates(["path"])


def _pages(w, where: str = "true", touched: str = "false"):
    """Pages as files, those that `touched` chooses changed later."""
    rows = w.table("pages").where(where)
    now, text = F.expr(touched), F.col("page_id").cast("string")
    return rows.select(text.alias("path"), F.when(now, 2.0).otherwise(1.0).alias("mtime"), F.sha2(F.when(now, text).otherwise(F.col("html")), 256).alias("hash"), F.col("page_id").alias("ord"))


@query("D5_staleness", "SELECT 'added' AS reason, CAST(min(page_id) FILTER (page_id % 5 = 3) AS VARCHAR) AS path FROM pages UNION ALL SELECT 'modified', CAST(min(page_id) FILTER (page_id % 7 = 4) AS VARCHAR) FROM pages UNION ALL SELECT 'removed', CAST(min(page_id) FILTER (page_id % 11 = 6) AS VARCHAR) FROM pages UNION ALL SELECT 'no-manifest', NULL")
def _(w):
    cases = [(_pages(w), _pages(w, "page_id % 5 <> 3")), (_pages(w, touched="page_id % 7 = 4"), _pages(w)), (_pages(w, "page_id % 11 <> 6"), _pages(w)), (_pages(w), _pages(w, "false"))]
    signs = [m.staleness(*x) for x in cases]
    return signs[0].unionByName(signs[1]).unionByName(signs[2]).unionByName(signs[3])


@query("D6_graph_status", "SELECT 'same' AS c, 'fresh' AS status UNION ALL SELECT 'touched', CASE WHEN count(*) = 0 THEN 'fresh' ELSE 'stale' END FROM pages WHERE page_id % 7 = 4")
def _(w):
    status = F.when(F.count("*") == 0, "fresh").otherwise("stale").alias("status")
    same, other = (m.staleness(_pages(w, touched=x), _pages(w)).agg(status) for x in ("false", "page_id % 7 = 4"))
    return same.select(F.lit("same").alias("c"), "status").unionByName(other.select(F.lit("touched").alias("c"), "status"))


@query("D7_workspace_staleness", "SELECT page_id % 3 AS repo, bool_or(page_id % 97 = 5) AS stale FROM pages GROUP BY 1")
def _(w):
    out = None
    for repo in range(3):
        signs = m.staleness(_pages(w, f"page_id % 3 = {repo}", "page_id % 97 = 5"), _pages(w, f"page_id % 3 = {repo}"))
        one = signs.agg((F.count("*") > 0).alias("stale")).select(F.lit(repo).cast("long").alias("repo"), "stale")
        out = one if out is None else out.unionByName(one)
    return out


# --- repositories


@query("X1_namespaced_merge", with_tables("edges") + "SELECT r || '::' || source AS source, r || '::' || target AS target, relation FROM edges, (VALUES ('left'), ('right')) v(r) WHERE relation IN ('contains', 'imports')")
def _(w):
    g = Graph(w.nodes, w.edges.where("relation in ('contains', 'imports')"))
    return multirepo.merged([("left", g), ("right", g)]).edges.select("source", "target", "relation")


@query("X2_workspace_nodes", with_tables("nodes") + "SELECT r || '::' || id AS id, r AS repo FROM nodes, (VALUES ('left'), ('right')) v(r)")
def _(w):
    g = plain(w)
    return multirepo.merged([("left", g), ("right", g)]).nodes.select("id", "repo")


#: Files of orders import the packages of nations; every fifth package has two publishers.
IMPORTS_SQL = with_tables("nodes") + """, files AS (SELECT repo, source_file AS file, min(id) AS first, max(id) AS last FROM nodes WHERE id LIKE 'order:%' GROUP BY ALL),
homes AS (SELECT n_nationkey AS n, n_name, n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey),
wanted AS (SELECT DISTINCT repo, source_file AS file, CAST(substr(id, 7) AS BIGINT) % 25 AS n FROM nodes WHERE id LIKE 'order:%'),
packages AS (SELECT n, r_name AS target_repo FROM homes UNION ALL SELECT n, r.r_name FROM homes JOIN region r ON r.r_regionkey = (n_regionkey + 1) % 5 WHERE n % 5 = 0),
found AS (SELECT repo, file, n, target_repo, CASE WHEN n % 5 = 0 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence FROM wanted JOIN packages USING (n) WHERE repo <> target_repo),
firsts AS (SELECT repo AS target_repo, min(id) AS any_id FROM nodes GROUP BY 1),
links AS (SELECT f.*, first, last, any_id, CASE WHEN r_name = target_repo THEN 'nation:' || f.n ELSE any_id END AS named FROM found f JOIN files USING (repo, file) JOIN firsts USING (target_repo) JOIN homes USING (n))
"""


def _imports(w):
    orders = w.nodes.where("id like 'order:%'").select("repo", F.col("source_file").alias("file"), F.pmod(F.substring("id", 7, 20).cast("long"), F.lit(25)).alias("n"))
    nation = w.table("nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name")
    rows = orders.distinct().join(nation, "n")
    return rows.select("repo", "file", F.concat(F.lit("pkg-"), F.col("n").cast("string"), F.lit("/deep/x")).alias("module"), F.array(F.lit("none"), "n_name").alias("names"))


def _matches(w):
    region = w.table("region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("target_repo"))
    nation = w.table("nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("pkg-"), F.col("n_nationkey").cast("string")).alias("package"), F.col("n_regionkey").cast("long").alias("k"))
    twice = nation.where("n % 5 = 0").withColumn("k", F.pmod(F.col("k") + 1, F.lit(5)))
    return multirepo.match_packages(_imports(w), nation.unionByName(twice).join(region, "k").select("package", "target_repo"))


@query("J11_package_match", IMPORTS_SQL + "SELECT repo, file, 'pkg-' || n || '/deep/x' AS module, target_repo, confidence FROM found")
def _(w):
    return _matches(w).select("repo", "file", "module", "target_repo", "confidence")


@query("X3_link_repos", IMPORTS_SQL + "SELECT first AS source, any_id AS target, max(confidence) AS confidence FROM links GROUP BY ALL")
def _(w):
    none = F.array().cast("array<string>")
    return multirepo.link_repos(_matches(w).withColumn("names", none), w.nodes).select("source", "target", "confidence")


@query("J12_use_sites", IMPORTS_SQL + "SELECT last AS source, named AS target, max(confidence) AS confidence FROM links GROUP BY ALL")
def _(w):
    code = w.nodes.where("id like 'order:%'").groupBy("repo", F.col("source_file").alias("file")).agg(F.max_by("label", "id").alias("label"))
    sites = _imports(w).join(code, ["repo", "file"])
    return multirepo.link_repos(_matches(w), w.nodes, sites).select("source", "target", "confidence")


@query("J13_target_selection", IMPORTS_SQL + "SELECT first AS source, named AS target, max(confidence) AS confidence FROM links GROUP BY ALL")
def _(w):
    return multirepo.link_repos(_matches(w), w.nodes).select("source", "target", "confidence")


LINKS = with_tables("nodes", "edges") + """, packages AS (SELECT 'customer:' || c_custkey AS package, r.r_name AS target_repo FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (VALUES (1, 10), (2, 30)) v(step, every) ON c_custkey % every = 0 JOIN region r ON r.r_regionkey = (n_regionkey + step) % 5),
publishers AS (SELECT package, count(*) AS n FROM packages GROUP BY 1), first_of AS (SELECT repo, min(id) AS target FROM nodes GROUP BY 1)
SELECT e.source, f.target, CASE WHEN min(p.n) = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence FROM edges e JOIN nodes s ON s.id = e.source JOIN packages k ON k.package = e.target AND k.target_repo <> s.repo JOIN publishers p USING (package) JOIN first_of f ON f.repo = k.target_repo WHERE e.relation = 'imports' GROUP BY ALL"""


@query("X3_link_imports", LINKS)
def _(w):
    region = w.table("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("target_repo"))
    home = w.table("customer").join(w.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    own = home.select(key("customer", "c_custkey").alias("package"), F.pmod(F.col("n_regionkey") + 1, F.lit(5)).alias("k")).where("cast(substring(package, 10) as long) % 10 = 0")
    twice = home.select(key("customer", "c_custkey").alias("package"), F.pmod(F.col("n_regionkey") + 2, F.lit(5)).alias("k")).where("cast(substring(package, 10) as long) % 30 = 0")
    packages = own.unionByName(twice).join(region, "k").select("package", "target_repo")
    none = w.spark.createDataFrame([], "repo string, file string, module string, names array<string>")
    return multirepo.link_workspace(plain(w), none, packages).select("source", "target", "confidence")


@query("X4_workspace_mode", "SELECT * FROM (VALUES ('flag', 'single'), ('declared', 'workspace'), ('children', 'workspace'), ('none', 'single')) v(c, mode)")
def _(w):
    rows = [("flag", multirepo.workspace_mode("single", True, 5)), ("declared", multirepo.workspace_mode(None, True, 0)), ("children", multirepo.workspace_mode(None, False, 2)), ("none", multirepo.workspace_mode(None, False, 1))]
    return w.spark.createDataFrame(rows, "c string, mode string")


def _candidates(w):
    """A root of every customer, by turns with a configured key, a remote, a git root, one child, two children and none of these."""
    k = F.col("c_custkey").cast("string")
    turn = lambda i, x: F.when(F.col("c_custkey") % 6 == i, x)
    text = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    children = F.coalesce(turn(3, F.array(text("/d/only", k))), turn(4, F.array(text("/e/1", k), text("/e/2", k))), F.array().cast("array<string>"))
    return w.table("customer").select(text("/c/", k).alias("root"), turn(0, text("My Key ", k)).alias("config"), turn(1, text("git@Host.x:Org/Repo", k, ".git")).alias("remote"), turn(2, text("/x/Proj_", k, "/")).alias("git_root"), children.alias("children"), text("F dir ", k).alias("basename"))


@query("X5_project_keys", """SELECT '/c/' || c_custkey AS root, CASE c_custkey % 6 WHEN 0 THEN 'my-key-' || c_custkey WHEN 1 THEN 'repo' || c_custkey WHEN 2 THEN 'proj-' || c_custkey WHEN 3 THEN 'only' || c_custkey WHEN 5 THEN 'f-dir-' || c_custkey END AS key,
    ['config', 'git_remote', 'git_root', 'git_child', 'ambiguous', 'dir_basename'][c_custkey % 6 + 1] AS method FROM customer""")
def _(w):
    return multirepo.derive_key(_candidates(w))


@query("X6_repo_identity", "SELECT '/c/' || c_custkey AS root, CASE WHEN c_custkey % 6 = 1 THEN 'host.x/org/repo' || c_custkey END AS remote, CASE c_custkey % 6 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM customer")
def _(w):
    return multirepo.identity_of(_candidates(w))


@query("X7_registry", "SELECT 'r' || user_id AS root, max_by('p' || (event_id % 7), event_id) AS project_key, max(event_id) AS last_build, user_id % 2 = 0 AS available FROM events GROUP BY user_id")
def _(w):
    rows = w.table("events").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("root"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("project_key"), F.col("event_id").alias("last_build"))
    merged = multirepo.registry_upsert(rows.where("last_build % 2 = 0"), rows.where("last_build % 2 = 1"))
    roots = w.table("events").where("user_id % 2 = 0").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("root"))
    return multirepo.registry_available(merged, roots)


# --- sources and sinks


PY = 'import os.path as p\nfrom .pkg import thing\nclass A(Base):\n    def run(self):\n        self.go()\n        helper(1)\n\ndef helper(x):\n    return p.join(x)\n'
TS = 'import { a } from "./a";\nexport class Box extends Base {\n  open(k: string) { return helper(k); }\n}\nfunction helper(x) { if (x) { return other.call(x); } }\n'
YAML = "services:\n  web:\n    image: nginx:1\n    build:\n      context: ./web\n    depends_on:\n      - db\n  db:\n    image: pg\n"
SOURCES = [("m.py", "py", PY), ("box.ts", "ts", TS), ("compose.yml", "yaml", YAML), ("bad.py", "py", "def ("), ("tab.yml", "yaml", "a:\n\tb: 1\n")]


def _files(w):
    return w.spark.createDataFrame(SOURCES, "path string, lang string, content string")


@query("S4_extract")
def _(w):
    return extract.extract(_files(w))


@query("S11_extract_yaml")
def _(w):
    return extract.extract(_files(w).where("lang = 'yaml'"))


@query("S10_function_spans")
def _(w):
    return extract.function_spans(_files(w))


RANGE_SQL = """WITH d AS (SELECT 'f' || c_nationkey AS path, 'customer:' || c_custkey AS symbol, c_custkey AS first, c_custkey + c_custkey % 37 * 10 AS last FROM customer), r AS (SELECT 'f' || c_nationkey AS path, c_custkey + 5 AS "at", 'customer:' || (c_custkey // 2) AS symbol FROM customer), h AS (SELECT r.path, r."at", r.symbol, first(d.symbol ORDER BY d.last - d.first, d.first DESC, d.symbol) AS name FROM r JOIN d ON d.path = r.path AND r."at" BETWEEN d.first AND d.last GROUP BY ALL)\n"""


def _ranges(w):
    c = w.table("customer")
    path = F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("path")
    d = c.select(path, key("customer", "c_custkey").alias("symbol"), F.col("c_custkey").alias("first"), (F.col("c_custkey") + F.col("c_custkey") % 37 * 10).alias("last"))
    return d, c.select(path, (F.col("c_custkey") + 5).alias("at"), key("customer", F.floor(F.col("c_custkey") / 2)).alias("symbol"))


@query("W14_innermost_range", RANGE_SQL + "SELECT path, \"at\", symbol, name FROM r LEFT JOIN h USING (path, \"at\", symbol)")
def _(w):
    d, r = _ranges(w)
    return extract.enclosing(r, d.withColumnRenamed("symbol", "name"))


@query("S8_symbol_graph", RANGE_SQL + "SELECT DISTINCT name AS source, symbol AS target, path, \"at\" FROM h WHERE name <> symbol AND symbol IN (SELECT symbol FROM d)")
def _(w):
    return extract.symbol_graph(*_ranges(w)).select("source", "target", "path", "at")


@query("S9_import_scan", """SELECT page_id, module, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS module FROM pages) GROUP BY ALL""")
def _(w):
    rows = files.imports_of(w.table("pages").select("page_id", F.col("html").alias("content")), "html")
    return rows.groupBy("page_id", "module").agg(F.count("*").alias("n"))


@query("S9_import_names", """SELECT 'p' || p_partkey || '.py' AS path, '.p' || p_partkey AS module, 'thing,other' AS names FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'p' || p_partkey || '.py', 'os.path', '' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'p' || p_partkey || '.ts', './p' || p_partkey, 'a,c' FROM part WHERE p_partkey % 2 = 1""")
def _(w):
    k = F.col("p_partkey").cast("string")
    py = w.table("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), k, F.lit(".py")).alias("path"), F.concat(F.lit("import os.path as p\nfrom .p"), k, F.lit(" import thing, other as o\n")).alias("content"))
    ts = w.table("part").where("p_partkey % 2 = 1").select(F.concat(F.lit("p"), k, F.lit(".ts")).alias("path"), F.concat(F.lit("import { a as b,\n  c } from './p"), k, F.lit("';\n")).alias("content"))
    return files.imports_of(py, "py").unionByName(files.imports_of(ts, "ts")).select("path", "module", F.array_join("names", ",").alias("names"))


@query("S12_package_names", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN '@s/s' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'g.s:art' || s_suppkey ELSE 'Asm' || s_suppkey END AS package FROM supplier")
def _(w):
    k, kind = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    name = F.when(kind == 0, "package.json").when(kind == 1, "pom.xml").otherwise("S.csproj")
    own = F.when(kind == 0, F.concat(F.lit('{"name": "@s/s'), k, F.lit('"}'))).when(kind == 1, F.concat(F.lit("<project><parent><artifactId>p</artifactId></parent><groupId>g.s</groupId><artifactId>art"), k, F.lit("</artifactId></project>")))
    own = own.otherwise(F.concat(F.lit("<Project><PropertyGroup><AssemblyName>Asm"), k, F.lit("</AssemblyName></PropertyGroup></Project>")))
    bare = F.when(kind == 0, "{}").when(kind == 1, "<project><version>1</version></project>").otherwise("<Project><ItemGroup/></Project>")
    rows = w.table("supplier").select("s_suppkey", name.alias("name"), F.when(F.col("s_suppkey") % 7 == 0, bare).otherwise(own).alias("content"))
    return rows.select("s_suppkey", files.package_name(F.col("name"), F.col("content")).alias("package"))


CACHE = "WITH f AS (SELECT page_id, sha256(html) AS hash FROM pages)"


def _cache(w):
    now = w.table("pages").select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("hash"))
    old = now.withColumns({"hash": F.when(F.col("path") % 5 == 0, "old").otherwise(F.col("hash")), "version": F.when(F.col("path") % 7 == 0, "1").otherwise("2")}).where("path % 3 <> 0")
    return resolve.cache_split(now, old, "2")


@query("S16_cache_misses", CACHE + " SELECT CAST(page_id AS VARCHAR) AS path, hash FROM f WHERE page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0")
def _(w):
    return _cache(w)[1]


@query("S16_cache_hits", CACHE + " SELECT CAST(page_id AS VARCHAR) AS path FROM f WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0")
def _(w):
    return _cache(w)[0].select("path")


@query("K7_manifest", "SELECT page_id, sha256(html) AS hash FROM pages")
def _(w):
    return w.table("pages").select("page_id", F.sha2("html", 256).alias("hash"))


@query("S18_parse_lines", "SELECT count(*) AS rows, count(*) FILTER (event_id % 10 = 0) AS bad FROM events")
def _(w):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType(), False)])
    lines = w.table("events").select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")).alias("value"))
    blank = w.spark.createDataFrame([("",), ("  ",)], "value string")
    return store.parse_lines(lines.unionByName(blank), schema).agg(F.count("*").alias("rows"), F.count("_error").alias("bad"))


@query("S20_batch_input", "SELECT * FROM (VALUES ('a', 1), ('b', 2)) v(title, n)")
def _(w):
    rows = w.spark.createDataFrame([('[{"title": "a", "n": 1}, {"title": "b", "n": 2}]',)], "j string")
    return rows.select(F.inline(F.from_json("j", "array<struct<title: string, n: int>>")))


@query("K6_node_link", with_tables("nodes", "edges") + "SELECT id, label AS a, kind AS b, repo AS c FROM nodes UNION ALL SELECT source, target, relation, CAST(weight AS VARCHAR) FROM edges")
def _(w):
    path = f"{shared_dir(w.spark)}/{uuid.uuid4().hex}"
    edges = cut(w.edges, "zstd")  # read for the first link, for the ranges of the sort and for the sort
    store.write_node_link(w.nodes, edges, path, "gzip")
    nodes, links = store.read_node_link(w.spark, path, w.nodes.schema, edges.schema)
    return nodes.select("id", F.col("label").alias("a"), F.col("kind").alias("b"), F.col("repo").alias("c")).union(links.select("source", "target", "relation", F.col("weight").cast("string")))


# --- events


@query("E1_envelopes", "SELECT 'event:' || event_id AS id, 'graph.built' AS type, epoch_us(ts) // 1000 AS ts, '{\"user\":' || user_id || '}' AS payload FROM events")
def _(w):
    e = outbox.envelope("graph.built", F.struct(F.col("user_id").alias("user")), key("event", "event_id"), millis("ts"))
    return w.table("events").select(e.alias("e")).select("e.id", "e.type", "e.ts", "e.payload")


@query("E3_tail", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || event_type || ' event:' || event_id AS line FROM events ORDER BY epoch_us(ts) // 1000 DESC, 'event:' || event_id DESC LIMIT 25")
def _(w):
    return outbox.tail(w.outbox, 25).select("line")


@query("S19_read_outbox", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def _(w):
    return w.outbox.groupBy("type").agg(F.count("*").alias("n"))


@query("E4_redact", "SELECT count(*) AS n FROM events")
def _(w):
    return outbox.redact(w.outbox, lambda df: df.withColumn("payload", F.lit("{}"))).agg(F.count("*").alias("n"))


@query("E6_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def _(w):
    return outbox.windowed_counts(w.outbox)


@query("V1_schema_check", "SELECT 'edges' AS name, CAST(0 AS BIGINT) AS missing")
def _(w):
    from pyspark.sql import types as T

    wanted = T.StructType([f for f in schemas.EDGES if f.name != "repo"])
    return w.spark.createDataFrame([("edges", len(schemas.missing_fields(w.edges, wanted)))], "name string, missing long")
