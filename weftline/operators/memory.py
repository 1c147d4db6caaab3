"""Versioned notes: topic evolution, updates, batches, import merge, project merge, federation, drift.

The stores of record are DataFrames; an operator takes the old rows and a batch and gives the
new rows. What the rows of a batch would do to each other in sequence is resolved by windows
over their key, in the order of the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NORMATIVE = ("decision", "preference")
TOPIC = ["project_key", "scope", "topic_key"]
STATES = ("active", "unverified", "stale", "contradicted")  # by severity


def observation_id(project: Column, kind: Column, topic_or_title: Column, ts: Column, unique: Column) -> Column:
    return F.concat_ws(":", project, kind, topic_or_title, ts.cast("string"), unique)


def evolve(saves: DataFrame) -> DataFrame:
    """All rows after a batch of saves (id, project_key, scope, type, title, content, topic_key, session_id, ts).

    Saves of one topic form a chain: the first one's id stays the live row, with the newest
    content, revision counting up and created_at kept; every state before is a snapshot that the
    live row supersedes, under its own id and a number. Saves without a topic stand alone.
    """
    chain = Window.partitionBy(*TOPIC, F.when(F.col("topic_key").isNull(), F.col("id"))).orderBy("ts", "id")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = saves.withColumns({"revision": F.row_number().over(chain), "last": F.count("*").over(whole), "live_id": F.first("id").over(whole), "created_at": F.first("ts").over(whole)})
    is_live = F.col("revision") == F.col("last")
    return rows.select(
        F.when(is_live, F.col("live_id")).otherwise(F.concat("live_id", F.lit("#"), F.col("revision").cast("string"))).alias("id"),
        "project_key", "scope", "type", "title", "content", "topic_key", "session_id", "created_at", F.col("ts").alias("updated_at"), "revision",
        F.when(~is_live, F.col("live_id")).alias("superseded_by"),
    )


def save(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with a batch of saves: chains continue from the live rows that are there."""
    live = old.where("superseded_by is null and topic_key is not null")
    touched = new.where("topic_key is not null").select(*TOPIC).distinct()
    base = live.join(touched, TOPIC, "left_semi")
    rest = old.join(base.select("id"), "id", "left_anti").select(*old.columns)
    first = base.select("id", *TOPIC, "type", "title", "content", "session_id", F.col("updated_at").alias("ts"), F.col("revision").alias("_r"), F.col("created_at").alias("_c"), F.lit(0).alias("_b"))
    rows = first.unionByName(new.select("id", *TOPIC, "type", "title", "content", "session_id", "ts", F.lit(0).alias("_r"), F.col("ts").alias("_c"), F.lit(1).alias("_b")))
    chain = Window.partitionBy(*TOPIC, F.when(F.col("topic_key").isNull(), F.col("id"))).orderBy("_b", "ts", "id")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.first("_r").over(whole)
    rows = rows.withColumns({"n": F.row_number().over(chain), "last": F.count("*").over(whole), "live_id": F.first("id").over(whole), "created_at": F.first("_c").over(whole), "revision": (F.when(start > 0, start - 1).otherwise(0) + F.row_number().over(chain)).cast("int")})
    is_live = F.col("n") == F.col("last")
    out = rows.withColumns({"superseded_by": F.when(~is_live, F.col("live_id")), "updated_at": F.col("ts"), "id": F.when(is_live, F.col("live_id")).otherwise(F.concat("live_id", F.lit("#"), F.col("revision").cast("string")))})
    return rest.unionByName(out.select(*old.columns))


def update(old: DataFrame, patch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): patch (id, title, content, type, topic_key; null keeps) applied to live rows, revision unchanged."""
    p = patch.select(F.col("id"), *[F.col(c).alias("_" + c) for c in ("title", "content", "type", "topic_key")], F.lit(True).alias("_p"))
    rows = old.join(p, "id", "left")
    hit = F.col("_p").isNotNull() & F.col("superseded_by").isNull()
    for c in ("title", "content", "type", "topic_key"):
        rows = rows.withColumn(c, F.when(hit, F.coalesce("_" + c, c)).otherwise(F.col(c)))
    rows = rows.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    state = patch.select("id").join(old.select("id", "superseded_by", F.lit(True).alias("_k")), "id", "left")
    errors = state.select("id", F.when(F.col("_k").isNull(), "not-found").when(F.col("superseded_by").isNotNull(), "superseded").alias("error")).where("error is not null")
    return rows.select(*old.columns), errors


def batch_results(checked: DataFrame, atomic: bool) -> DataFrame:
    """(index, ok, error) of checked (index, error): an atomic batch with any error rolls all others back."""
    if not atomic:
        return checked.select("index", F.col("error").isNull().alias("ok"), "error")
    broken = checked.agg(F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("b"))
    rows = checked.join(F.broadcast(broken))  # one row
    return rows.select("index", (~F.col("b")).alias("ok"), F.coalesce("error", F.when(F.col("b"), "rolled-back")).alias("error"))


def get_batch(observations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(requested, found columns...): ids may start with #; unknown ones come with nulls."""
    w = wanted.select(F.col("id").alias("requested"), F.regexp_replace("id", "^#", "").alias("id"))
    return w.join(observations, "id", "left")


def recent(observations: DataFrame, n: int = 20) -> DataFrame:
    return observations.where("superseded_by is null").orderBy(F.desc("updated_at"), "id").limit(n)


def recent_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "id").limit(n)


def end_sessions(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """sessions with ended (id, project_key, scope, title, summary, ts) ended, those not known being added as begun and ended at once."""
    e = ended.select("id", *[F.col(c).alias("_" + c) for c in ("project_key", "scope", "title", "summary", "ts")])
    both = sessions.join(e, "id", "full_outer")
    pick = lambda c: F.coalesce("_" + c, c).alias(c)
    return both.select("id", F.coalesce("project_key", "_project_key").alias("project_key"), F.coalesce("scope", "_scope").alias("scope"), pick("title"), pick("summary"), F.coalesce("started_at", "_ts").alias("started_at"), F.coalesce("_ts", "ended_at").alias("ended_at")).select(*sessions.columns)


def add_anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new whose (observation_id, node_id, role) is not there yet, one each."""
    key = ["observation_id", "node_id", "role"]
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns)


def resolve_anchors(labels: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(observation_id, node_id, anchor_label, anchor_file, anchor_hash) of each node with the label; none found keeps the label with null file."""
    from weftline.functions.identity import normalize_label

    n = nodes.select("id", "source_file", normalize_label(F.col("label")).alias("name")).join(hashes.select("id", "hash"), "id", "left")
    rows = labels.withColumn("name", normalize_label(F.col("label"))).join(n, "name", "left")
    return rows.select("observation_id", F.coalesce("id", "label").alias("node_id"), F.col("label").alias("anchor_label"), F.col("source_file").alias("anchor_file"), F.col("hash").alias("anchor_hash"))


def import_merge(old: DataFrame, items: DataFrame, project: str) -> DataFrame:
    """Every row after importing items (the columns of old) into project, with `action` inserted, updated, skipped or kept.

    The newer of an id by (revision, updated_at), strictly, wins. Among live rows of one topic
    the newest stays, the others are superseded by it; that also settles items of one batch
    against each other.
    """
    newest = F.struct("revision", "updated_at", "id")
    items = items.withColumn("project_key", F.lit(project))
    items = items.groupBy("id").agg(F.max_by(F.struct(*items.columns), F.struct("revision", "updated_at")).alias("i"))
    both = old.select("id", F.struct(*old.columns).alias("o")).join(items, "id", "full_outer")
    wins = F.col("o").isNull() | (F.struct(F.col("i.revision"), F.col("i.updated_at")) > F.struct(F.col("o.revision"), F.col("o.updated_at")))
    take = F.col("i").isNotNull() & wins
    action = F.when(F.col("i").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(wins, "updated").otherwise("skipped")
    rows = both.select(action.alias("action"), *[F.when(take, F.col(f"i.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])
    open_topic = F.col("superseded_by").isNull() & F.col("topic_key").isNotNull()
    by = Window.partitionBy(*TOPIC, open_topic, F.when(~open_topic, F.col("id")))
    rows = rows.withColumn("_w", F.max_by("id", newest).over(by))
    lost = open_topic & (F.col("_w") != F.col("id"))
    return rows.withColumns({"superseded_by": F.when(lost, F.col("_w")).otherwise(F.col("superseded_by")), "conflict": lost}).drop("_w")


def merge_collisions(observations: DataFrame, source: str, into: str) -> DataFrame:
    """(from_id, into_id) of live rows of both projects with one scope and topic."""
    live = observations.where("superseded_by is null and topic_key is not null")
    a = live.where(F.col("project_key") == source).select("scope", "topic_key", F.col("id").alias("from_id"))
    b = live.where(F.col("project_key") == into).select("scope", "topic_key", F.col("id").alias("into_id"))
    return a.join(b, ["scope", "topic_key"]).select("from_id", "into_id")


def merge_project(observations: DataFrame, source: str, into: str) -> DataFrame:
    """Live rows of source go to into; those that collide stay, superseded by into's row, as do old snapshots."""
    hit = merge_collisions(observations, source, into).groupBy(F.col("from_id").alias("id")).agg(F.min("into_id").alias("_into"))
    rows = observations.join(hit, "id", "left")
    moved = (F.col("project_key") == source) & F.col("superseded_by").isNull() & F.col("_into").isNull()
    return rows.withColumns({"project_key": F.when(moved, F.lit(into)).otherwise(F.col("project_key")), "superseded_by": F.coalesce("superseded_by", "_into")}).select(*observations.columns)


def federated(results: DataFrame, limit: int = 10) -> DataFrame:
    """Search results of several stores (id, score, store_rank, ...): an id's first store counts; best score first."""
    first = results.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("store_rank"))).where("_rn = 1").drop("_rn")
    return first.orderBy(F.desc("score"), "store_rank", "id").limit(limit)


def orphan_counts(observations: DataFrame, keys: list[str]) -> DataFrame:
    return observations.where(F.col("superseded_by").isNull() & F.col("project_key").isin(*keys)).groupBy("project_key").agg(F.count("*").alias("n"))


def export(observations: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows with their anchors in order of (node_id, role), and schemaVersion 1; sort by created_at and id when writing."""
    key = F.struct("node_id", "role", "anchor_label", "anchor_file", "anchor_hash")
    by = anchors.groupBy(F.col("observation_id").alias("id")).agg(F.array_sort(F.collect_list(key)).alias("anchors"))
    out = observations.join(by, "id", "left")
    return out.withColumns({"schemaVersion": F.lit(1), "anchors": F.coalesce("anchors", F.array().cast(by.schema["anchors"].dataType))})


def anchor_states(anchors: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """anchors with state and reason: the node gone is contradicted, its file's hash another is stale; without file or hash unverified."""
    n = nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("_exists"))
    h = hashes.select(F.col("id").alias("node_id"), F.col("hash").alias("_hash"))
    rows = anchors.join(n, "node_id", "left").join(h, "node_id", "left")
    pick = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    state = (
        F.when(F.col("anchor_file").isNull(), pick("unverified", "no-file")).when(F.col("_exists").isNull(), pick("contradicted", "node-gone"))
        .when(F.col("anchor_hash").isNull() | F.col("_hash").isNull(), pick("unverified", "no-hash")).when(F.col("anchor_hash") != F.col("_hash"), pick("stale", "hash-differs"))
        .otherwise(pick("active", "matches"))
    )
    return rows.withColumn("s", state).select(*anchors.columns, "s.*")


def severity(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state)


def memory_states(observations: DataFrame, states: DataFrame) -> DataFrame:
    """(id, type, state, reason): the worst anchor, the first of equals by node_id; without anchors unverified."""
    worst = states.groupBy(F.col("observation_id").alias("id")).agg(F.min_by(F.struct("state", "reason"), F.struct(-severity(F.col("state")), "node_id", "role")).alias("w"))
    rows = observations.select("id", "type").join(worst, "id", "left")
    return rows.select("id", "type", F.coalesce("w.state", F.lit("unverified")).alias("state"), F.coalesce("w.reason", F.lit("no-anchors")).alias("reason"))


def verdicts(states: DataFrame) -> DataFrame:
    """states with verdict and check_violation: what a rule says stays usable, what describes code does only while it matches."""
    rule = F.col("type").isin(*NORMATIVE)
    bad = F.col("state").isin("stale", "contradicted")
    verdict = F.when(F.col("state") == "active", "usable").when(rule & bad, "usable").when(rule, "warning").when(F.col("state") == "contradicted", "do_not_use").otherwise("warning")
    return states.withColumns({"verdict": verdict, "check_violation": rule & bad})


def verified_context(hits: DataFrame, anchors: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Search hits (id, type, rank) with the state of what they are anchored to and the verdict on it."""
    own = anchors.join(hits.select(F.col("id").alias("observation_id")), "observation_id", "left_semi")
    return verdicts(memory_states(hits, anchor_states(own, nodes, hashes))).join(hits.select("id", "rank"), "id")


def anchored(anchors: DataFrame, observations: DataFrame, node_id: str, n: int = 10) -> DataFrame:
    """The n newest live rows anchored to a node."""
    ids = anchors.where(F.col("node_id") == node_id).select(F.col("observation_id").alias("id")).distinct()
    return observations.where("superseded_by is null").join(ids, "id", "left_semi").orderBy(F.desc("updated_at"), "id").limit(n)


def reanchor(candidates: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, pos, label, node_id, outcome): labels with exactly one node become anchors, unless it is there or was minted before in the row."""
    from weftline.functions.identity import normalize_label

    named = nodes.groupBy(normalize_label(F.col("label")).alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("node_id"))
    rows = candidates.withColumn("name", normalize_label(F.col("label"))).join(named, "name", "left")
    have = anchors.select(F.col("observation_id").alias("id"), "node_id", F.lit(True).alias("_have")).distinct()
    rows = rows.withColumn("node_id", F.when(F.col("n") == 1, F.col("node_id"))).join(have, ["id", "node_id"], "left")
    again = F.row_number().over(Window.partitionBy("id", "node_id").orderBy("pos"))
    outcome = F.when(F.col("n").isNull(), "no-node").when(F.col("n") > 1, "ambiguous").when(F.col("_have"), "present").when(again > 1, "repeated").otherwise("minted")
    return rows.select("id", "pos", "label", "node_id", outcome.alias("outcome"))


def staleness(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(reason, path) of the first sign of change, none if fresh. current and manifest: path, mtime, hash, ord.

    Without a manifest that is the sign; then the first file that was added; then, in the
    manifest's order, the first that was removed or touched (mtime later and hash another).
    """
    c = current.select("path", F.col("mtime").alias("cm"), F.col("hash").alias("ch"), F.col("ord").alias("co"))
    m = manifest.select("path", F.col("mtime").alias("mm"), F.col("hash").alias("mh"), F.col("ord").alias("mo"))
    both = c.join(m, "path", "full_outer")
    touched = (F.col("cm") > F.col("mm")) & (F.col("ch") != F.col("mh"))
    reason = F.when(F.col("mo").isNull(), "added").when(F.col("co").isNull(), "removed").when(touched, "modified")
    signs = both.select(reason.alias("reason"), "path", F.struct(F.col("mo").isNotNull(), F.coalesce("mo", "co"), "path").alias("o")).where("reason is not null")
    first = signs.orderBy("o").limit(1).select("reason", "path")
    none = manifest.agg((F.count("*") == 0).alias("none"))
    missing = none.where("none").select(F.lit("no-manifest").alias("reason"), F.lit(None).cast("string").alias("path"))
    return first.join(F.broadcast(none.where("not none"))).drop("none").unionByName(missing)
