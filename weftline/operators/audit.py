"""Security audit: catalog match, source-to-sink paths, findings, size-bounded packs."""

from __future__ import annotations

import json
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.traversal import EDGE_ORDER, Graph, reachable, source_sink_paths
from weftline.plans.lineage import cut

# Severities from the worst, and findings by a sink's category as (type, severity).
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
FINDING_KINDS = {
    "eval": ("code-injection", "HIGH"),
    "exec": ("command-injection", "HIGH"),
    "sql": ("sql-injection", "HIGH"),
    "ssrf": ("ssrf", "HIGH"),
    "path-traversal": ("path-traversal", "MEDIUM"),
    "template-render": ("template-injection", "MEDIUM"),
    "weak-crypto": ("weak-crypto", "MEDIUM"),
}
# What a finding of each type asks for; the last is for all others.
SUGGESTED = {
    "code-injection": [
        "Evitar pasar datos controlados por el usuario a eval() o new Function().",
        "Usar una librería de evaluación sandboxed o un parser de expresiones estático.",
        "Si se requiere ejecución dinámica, validar y aplicar allowlist estricta de expresiones.",
    ],
    "command-injection": [
        "Nunca interpolar input del usuario en comandos de shell.",
        "Usar APIs parametrizadas (execFile con array de args, sin shell: true).",
        "Aplicar validación de input y allowlist de comandos permitidos.",
    ],
    "sql-injection": [
        "Usar consultas parametrizadas o prepared statements — nunca concatenación de strings.",
        "Aplicar query builders con parámetros vinculados (ORM/Knex/pg parameterized).",
        "Validar y sanitizar todos los valores de usuario antes de interactuar con la DB.",
    ],
    "ssrf": [
        "Validar las URLs salientes contra un allowlist de hosts y esquemas permitidos.",
        "Bloquear peticiones a rangos IP internos/privados (RFC 1918, loopback, link-local).",
        "Usar un proxy de egreso con filtrado estricto de destinos.",
    ],
    "path-traversal": [
        "Normalizar la ruta con path.resolve() y verificar que comienza con el directorio base esperado.",
        "Rechazar paths con segmentos '..' antes de la resolución.",
        "Usar una allowlist de extensiones y directorios permitidos.",
    ],
    "template-injection": [
        "Nunca pasar strings controlados por el usuario como fuente de template.",
        "Usar un motor de templates sandboxed con auto-escape habilitado.",
        "Separar las definiciones de template (estáticas) de los datos de renderizado (dinámicos).",
    ],
    "weak-crypto": [
        "Reemplazar MD5/SHA-1 con SHA-256 o superior para fines de seguridad.",
        "Usar cifrado autenticado (AES-GCM) en lugar de modos no autenticados.",
        "Evitar algoritmos criptográficos obsoletos o personalizados.",
    ],
    "taint-flow": [
        "Revisar el flujo de taint de source a sink y evaluar su explotabilidad.",
        "Aplicar validación de input en el punto de entrada del source.",
        "Agregar una tarea de revisión de seguridad para este flujo de datos.",
    ],
}
# Sinks outside the graph, as (id, label, category).
SYNTHETIC_SINKS = (
    ("__sink__eval", "eval()", "eval"),
    ("__sink__exec", "child_process.exec", "exec"),
    ("__sink__spawn", "child_process.spawn", "exec"),
    ("__sink__sql_concat", "SQL string concat", "sql"),
    ("__sink__path_write", "fs.writeFile", "path-traversal"),
    ("__sink__fetch_user", "fetch(userUrl)", "ssrf"),
    ("__sink__render_template", "renderTemplate()", "template-render"),
    ("__sink__weak_hash", "createHash(md5)", "weak-crypto"),
)
# The built-in patterns, as (name, role, category, parts of labels, any of which qualifies a node).
PATTERNS = (
    ("src-http-handler", "source", "http-request", ("handler", "controller", "route", "endpoint", "requesthandler", "onrequest", "handlerequest")),
    ("src-http-lambda", "source", "http-request", ("lambdahandler", "apigwhandler")),
    ("src-env-argv", "source", "env-argv", ("parseargs", "parseargv", "getargs", "readenv", "loadenv")),
    ("src-stdin", "source", "stdin", ("readstdin", "readinput", "parseinput", "getstdin")),
    ("src-deserialize", "source", "deserialize", ("deserialize", "fromjson", "parsejson", "parseyaml", "parsetoml", "parsexml")),
    ("src-message-consumer", "source", "message-consumer", ("consume", "subscribe", "onmessage", "processmessage", "handleevent", "receivemessage", "processevent")),
    ("sink-eval", "sink", "eval", ("evalcode", "runeval", "executeeval", "dynamiceval", "safeeval", "unsafeeval")),
    ("sink-vm-run", "sink", "eval", ("runscript", "executescript", "runcode", "runinnewcontext", "runincontext")),
    ("sink-exec", "sink", "exec", ("execcommand", "runcommand", "spawnprocess", "execshell", "shellexec", "runshell", "executecommand")),
    ("sink-exec-py", "sink", "exec", ("runcommand", "execshell", "callprocess", "spawnprocess")),
    ("sink-sql", "sink", "sql", ("rawquery", "unsafequery", "buildquery", "constructsql", "executesql", "runsql", "querydb")),
    ("sink-path-traversal", "sink", "path-traversal", ("writefile", "savefile", "writepath", "savepath", "appendfile", "deletefile", "removefile")),
    ("sink-template-render", "sink", "template-render", ("rendertemplate", "compiletemplate", "renderview", "rendershtml", "buildhtml")),
    ("sink-ssrf", "sink", "ssrf", ("fetchurl", "makehttp", "sendhttprequest", "callexternal", "forwardrequest", "proxyrequest")),
    ("sink-weak-crypto", "sink", "weak-crypto", ("hashmd5", "hashsha1", "md5hash", "sha1hash", "weakcipher", "desencrypt", "rc4encrypt")),
)
PACK_BYTES = 128 * 1024


def builtin_catalog(spark: SparkSession) -> DataFrame:
    """(name, role, category, needle, ord) of the built-in patterns, a row for each part of a label."""
    rows = [(name, role, category, needle, i) for i, (name, role, category, needles) in enumerate(PATTERNS) for needle in needles]
    return spark.createDataFrame(rows, "name string, role string, category string, needle string, ord int")


def effective_catalog(builtin: DataFrame, add: DataFrame | None = None, remove: list[str] | None = None) -> DataFrame:
    """builtin patterns (name, role, category, needle, ord) without those named in remove, with those of add after them."""
    out = builtin.where(~F.col("name").isin(*remove)) if remove else builtin
    if add is not None:
        out = out.unionByName(add.withColumn("ord", F.col("ord") + 1_000_000))
    return out


#: Up to this many needles are compared with every label; more are found by their grams.
CASES = 200
#: Up to this many grams of needles are broadcast.
BROADCAST_GRAMS = 500_000
#: Needles are found by grams as long as they are themselves, or by the rarest of this length; shorter ones are compared with every label.
GRAM, WIDEST = 3, 16


def match_catalog(nodes: DataFrame, catalog: DataFrame, cases: int = CASES) -> DataFrame:
    """(id, role, name, category): the first pattern, in catalog order, that each node's label holds, per role.

    Few needles become one CASE a role, without a join; of a large catalog only those shorter than a gram do.
    """
    patterns = catalog.orderBy("ord").limit(cases + 1).collect()
    if len(patterns) <= cases:
        return _by_case(nodes, patterns)
    short = catalog.where(F.length("needle") < GRAM).select("role", "name", "category", "needle", "ord").distinct().orderBy("ord").collect()  # of one or two characters
    return _first(_by_gram(nodes, catalog.where(F.length("needle") >= GRAM)).unionByName(_each(nodes, short)))


def _by_case(nodes: DataFrame, patterns: list) -> DataFrame:
    label, rows = F.lower("label"), []
    for role in sorted({p["role"] for p in patterns}):
        own = [p for p in patterns if p["role"] == role]
        hit = F.coalesce(*[F.when(F.contains(label, F.lit(p["needle"].lower())), F.struct(F.lit(p["name"]).alias("name"), F.lit(p["category"]).alias("category"))) for p in own])
        rows.append(nodes.select("id", F.lit(role).alias("role"), hit.alias("h")).where("h is not null").select("id", "role", "h.*"))
    out = rows[0] if rows else nodes.select("id", *[F.lit("").alias(c) for c in ("role", "name", "category")]).where("false")
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def grams(text: Column, width: int | Column = GRAM) -> Column:
    """The different `width` characters in a row of a text."""
    width = F.lit(width) if isinstance(width, int) else width
    n = F.length(text) - width + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, width)))).otherwise(F.array().cast("array<string>"))


def _by_gram(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, role, name, category, ord) of the first pattern of each role and needle, for every label that holds it.

    Different labels meet the needles that are one of their grams, or whose rarest gram is one,
    and are then compared. Patterns with the same needle and role, and nodes with the same label,
    count once.
    """
    first = F.min_by(F.struct("name", "category", "ord"), F.struct("ord", "name")).alias("h")
    needles = cut(catalog.groupBy("role", F.lower("needle").alias("needle")).agg(first).select("role", "needle", "h.*"))
    own = needles.select("needle").distinct().withColumn("width", F.least(F.length("needle"), F.lit(WIDEST)))
    of_needles = cut(own.select("needle", "width", F.explode(grams(F.col("needle"), F.col("width"))).alias("gram")))
    widths = sorted(r["width"] for r in of_needles.select("width").distinct().collect())  # WIDEST at most
    labels = nodes.select(F.lower("label").alias("label")).where("label is not null").distinct()
    if not widths:
        return nodes.select("id").join(needles.where("false"))
    cuts = lambda widths: labels.select("label", F.explode(F.flatten(F.array(*[grams(F.col("label"), w) for w in widths]))).alias("gram"))
    long = F.length("needle") > WIDEST
    asked = of_needles.where(~long).select("needle", "gram")
    if widths[-1] == WIDEST:  # of those that may be longer, the rarest gram
        of_long = of_needles.where(long)
        few = of_long.count() <= BROADCAST_GRAMS
        grams_of = of_long.select("gram").distinct()
        often = cuts([WIDEST]).join(F.broadcast(grams_of) if few else grams_of, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        rarest = of_long.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
        asked = asked.unionByName(rarest.select("needle", "g.gram"))
    asked = cut(asked)
    few = asked.count() <= BROADCAST_GRAMS
    found = cuts(widths).join(F.broadcast(asked) if few else asked, "gram").where(F.contains("label", F.col("needle")))
    hit = _first(found.select("label", "needle").join(needles, "needle").withColumnRenamed("label", "id"), "ord").withColumnRenamed("id", "label")
    return nodes.select("id", F.lower("label").alias("label")).join(hit, "label").select("id", "role", "name", "category", "ord")


def _each(nodes: DataFrame, patterns: list) -> DataFrame:
    held = [F.when(F.contains(F.lower("label"), F.lit(p["needle"].lower())), F.struct(*[F.lit(p[c]).alias(c) for c in ("role", "name", "category", "ord")])) for p in patterns]
    rows = nodes.select("id", F.explode(F.array_compact(F.array(*held))).alias("h")).select("id", "h.*") if held else None
    return rows if rows is not None else nodes.select("id", *[F.lit("").alias(c) for c in ("role", "name", "category")], F.lit(0).alias("ord")).where("false")


def _first(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("id", "role").agg(F.min_by(F.struct("name", "category", *more), F.struct("ord", "name")).alias("h")).select("id", "role", "h.*")


def findings(paths: DataFrame, sinks: DataFrame) -> DataFrame:
    """One finding a path (source, sink, path, weakest), by the sink's category; the id hashes source, sink and the pair's path number."""
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("source", "sink").orderBy("hops", "path")) - 1
    kinds = sinks.select(F.col("id").alias("sink"), "category").dropDuplicates(["sink"])
    rows = paths.withColumn("idx", number).join(kinds, "sink", "left")
    for name, _, category in SYNTHETIC_SINKS:
        rows = rows.withColumn("category", F.when(F.col("category").isNull() & (F.col("sink") == name), category).otherwise(F.col("category")))
    kind, severity = F.lit("taint-flow"), F.lit("LOW")
    for c, (t, s) in FINDING_KINDS.items():
        kind, severity = F.when(F.col("category") == c, t).otherwise(kind), F.when(F.col("category") == c, s).otherwise(severity)
    ident = F.substring(F.sha2(F.concat_ws("::", "source", "sink", F.col("idx").cast("string")), 256), 1, 16)
    inner = F.array_distinct(F.array_except(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0))), F.array("source", "sink")))
    return rows.select(ident.alias("id"), kind.alias("type"), severity.alias("severity"), "source", "sink", inner.alias("related"), F.col("weakest").alias("confidence"), "path", "relations", "confidences")


def severity_rank(column: str = "severity"):
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(column))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(severity_rank(), "id")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


#: Paths of the first kinds are kept, those of the last are left out first.
PACK_ORDER = ("EXTRACTED", "INFERRED", "AMBIGUOUS", "SYNTACTIC")
DISCLAIMER = "These are candidate paths for review, not confirmed vulnerabilities."
CHUNK = 256  # paths whose nodes and edges are fetched at once
LEAST_PATH = 150  # bytes; no path and its finding take less


def serialised(pack: dict) -> str:
    return json.dumps(pack, ensure_ascii=False, separators=(",", ":"))


def _bytes(x: object) -> int:
    return len(serialised(x).encode())


def _fetched(g: Graph, known: set[str], new: set[str]) -> tuple[dict[str, dict], list[tuple[str, str, dict]]]:
    """The nodes among `new`, and the edges that join those with each other or with `known`."""
    ids = F.broadcast(g.nodes.sparkSession.createDataFrame([(x, x in new) for x in sorted(known | new)], "id string, fresh boolean"))  # a chunk's
    nodes = g.nodes.join(ids.where("fresh").select("id"), "id", "left_semi").select("id", F.to_json(F.struct(*g.nodes.columns)).alias("j")).collect()
    ends = [ids.select(F.col("id").alias(end), F.col("fresh").alias(f"_{end}")) for end in ("source", "target")]
    edges = g.edges
    for end in ends:  # first as a semi-join, which Spark takes below what the edges are computed by
        edges = edges.join(end.select(end.columns[0]), end.columns[0], "left_semi")
    edges = edges.join(ends[0], "source").join(ends[1], "target").where("_source or _target")
    edges = edges.select("source", "target", F.to_json(F.struct(*g.edges.columns)).alias("j")).orderBy(*EDGE_ORDER).collect()
    return {r["id"]: json.loads(r["j"]) for r in nodes}, [(r["source"], r["target"], json.loads(r["j"])) for r in edges]


def build_pack(found: DataFrame, g: Graph, max_bytes: int = PACK_BYTES, built_at: int = 0) -> dict:
    """Paths by confidence while the serialised pack, with the nodes of its paths and all edges among them, is within max_bytes.

    A path too large leaves nothing behind and later ones may fit. Paths come to the driver one
    partition at a time, and none once no path could fit.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in PACK_ORDER]), F.col("confidence"))
    total = found.count()
    rows = found.orderBy(rank, "source", "sink", "id").toLocalIterator()
    pack = {"schemaVersion": 3, "disclaimer": DISCLAIMER, "builtAt": built_at, "reposInvolved": [], "paths": [], "nodes": [], "edges": [], "prunedPaths": total, "findings": []}
    size, inside, repos = _bytes(pack), set(), []
    nodes: dict[str, dict] = {}
    while max_bytes - size >= LEAST_PATH and (chunk := list(islice(rows, CHUNK))):
        new = {x for r in chunk for x in r["path"]} - inside
        more, edges = _fetched(g, inside, new)
        nodes = {k: v for k, v in nodes.items() if k in inside} | more
        touching: dict[str, list[int]] = {}
        for i, (a, b, _) in enumerate(edges):
            for end in {a, b} & new:
                touching.setdefault(end, []).append(i)
        for r in chunk:
            steps = [{"from": a, "to": b, "relation": k, "confidence": c} for a, b, k, c in zip(r["path"], r["path"][1:], r["relations"], r["confidences"], strict=False)]
            crossed = list(dict.fromkeys(nodes[x]["repo"] for x in r["path"] if nodes.get(x, {}).get("repo")))
            path = {"source": r["source"], "sink": r["sink"], "steps": steps, "minConfidence": r["confidence"], "reposTraversed": crossed}
            name = {end: nodes.get(r[end], {}).get("label", r[end]) for end in ("source", "sink")}
            finding = {
                "id": r["id"], "type": r["type"], "severity": r["severity"], "title": f"{r['type']}: {name['source']} → {name['sink']}",
                "description": f"{name['sink']} can be reached from {name['source']} in {len(steps)} steps; check what is passed on for {r['type']}.",
                "evidence": {"sourceNodeId": r["source"], "sinkNodeId": r["sink"], "steps": steps, "reposTraversed": crossed},
                "relatedNodes": r["related"], "suggestedActions": SUGGESTED[r["type"]], "confidence": r["confidence"], "source": "audit.run", "createdAt": built_at,
            }
            fresh = [x for x in dict.fromkeys(r["path"]) if x not in inside]
            reach = inside | set(fresh)
            joined = sorted({i for x in fresh for i in touching.get(x, ()) if edges[i][0] in reach and edges[i][1] in reach})
            added = {"paths": [path], "findings": [finding], "nodes": [nodes[x] for x in fresh if x in nodes], "edges": [edges[i][2] for i in joined], "reposInvolved": [x for x in crossed if x not in repos]}
            commas = sum(len(xs) - (not pack[k]) for k, xs in added.items() if xs)
            grown = size + commas + sum(_bytes(x) for xs in added.values() for x in xs)
            if grown <= max_bytes:
                for k, xs in added.items():
                    pack[k] += xs
                inside, repos, size = reach, pack["reposInvolved"], grown
    pack["prunedPaths"] = total - len(pack["paths"])
    return pack


def _sorted(pack: dict) -> list[dict]:
    return sorted(pack["findings"], key=lambda f: (SEVERITIES.index(f["severity"]), f["id"]))


def _tally(pack: dict) -> list[tuple[str, int]]:
    return [(s, sum(f["severity"] == s for f in pack["findings"])) for s in SEVERITIES]


def _way(finding: dict) -> list[str]:
    steps = finding["evidence"]["steps"]
    return [finding["evidence"]["sourceNodeId"], *(f"{s['relation']} ({s['confidence']}) {s['to']}" for s in steps)]


def render_markdown(pack: dict) -> str:
    """Counts by severity, then each finding, by severity and id, with its way and what it asks for."""
    out = ["# Audit", "", f"> {pack['disclaimer']}", "", f"{len(pack['findings'])} findings, {pack['prunedPaths']} paths left out.", "", "| Severity | Findings |", "|---|---|"]
    out += [f"| {s} | {n} |" for s, n in _tally(pack)]
    for f in _sorted(pack):
        out += ["", f"## {f['severity']} {f['title']}", "", f"`{f['id']}` · {f['type']} · {f['confidence']}", "", f["description"], "", "Way: `" + " → ".join(_way(f)) + "`", ""]
        out += [f"- {x}" for x in f["suggestedActions"]]
    return "\n".join(out) + "\n"


def render_html(pack: dict) -> str:
    """As render_markdown, as a page; every value is escaped."""
    import html

    esc = lambda x: html.escape(str(x))
    tally = "".join(f"<tr><td>{s}</td><td>{n}</td></tr>" for s, n in _tally(pack))
    body = "".join(
        f"<section><h2>{esc(f['severity'])} {esc(f['title'])}</h2><p><code>{esc(f['id'])}</code> {esc(f['type'])} {esc(f['confidence'])}</p><p>{esc(f['description'])}</p>"
        f"<ol>{''.join(f'<li>{esc(x)}</li>' for x in _way(f))}</ol><ul>{''.join(f'<li>{esc(x)}</li>' for x in f['suggestedActions'])}</ul></section>"
        for f in _sorted(pack)
    )
    return f"<!doctype html><meta charset=utf-8><title>Audit</title><h1>Audit</h1><p>{esc(pack['disclaimer'])}</p><table>{tally}</table>{body}"


def roles(ids: DataFrame, sources: DataFrame, sinks: DataFrame, synthetic: str = "__sink__") -> DataFrame:
    """(id, role): sink before source before waypoint; synthetic sinks by prefix."""
    s, t = sources.select("id", F.lit(True).alias("_s")).distinct(), sinks.select("id", F.lit(True).alias("_t")).distinct()
    role = F.when(F.startswith("id", F.lit(synthetic)), "synthetic-sink").when(F.col("_t").isNotNull(), "sink").when(F.col("_s").isNotNull(), "source").otherwise("waypoint")
    return ids.select("id").join(s, "id", "left").join(t, "id", "left").select("id", role.alias("role"))


def with_synthetic_sinks(g: Graph) -> Graph:
    """The graph with a node for each of SYNTHETIC_SINKS, never stored."""
    rows = g.nodes.sparkSession.createDataFrame([x[:2] for x in SYNTHETIC_SINKS], "id string, label string")
    fixed = {"kind": "concept", "file_type": "concept", "source_file": "__synthetic__"}
    more = [F.col(c) if c in ("id", "label") else F.lit(fixed.get(c)).cast(t).alias(c) for c, t in g.nodes.dtypes]
    return Graph(g.nodes.unionByName(rows.select(*more)), g.edges)


def restricted(g: Graph, ids: DataFrame) -> Graph:
    """The graph on ids (id) alone."""
    from weftline.operators.traversal import induced

    nodes = g.nodes.join(ids.select("id"), "id", "left_semi").select(*g.nodes.columns)
    return Graph(nodes, induced(g.edges, nodes))


def run_audit(g: Graph, catalog: DataFrame, max_hops: int = 20, max_bytes: int = PACK_BYTES) -> dict:
    hit = match_catalog(g.nodes, catalog)
    sources, sinks = hit.where("role = 'source'"), hit.where("role = 'sink'")
    return build_pack(findings(source_sink_paths(g, sources, sinks, max_hops), sinks), g, max_bytes)


def repo_reachability(g: Graph, entries: DataFrame) -> DataFrame:
    """(repo, reachable, total, coverage) for each repository, from entries over the whole graph."""
    flags = reachable(g, entries).join(g.nodes.select("id", F.coalesce("repo", F.lit("unknown")).alias("repo")), "id")
    n, hit = F.count("*"), F.count_if("reached")
    return flags.groupBy("repo").agg(hit.alias("reachable"), n.alias("total"), F.floor(hit * 100 / n + 0.5).cast("long").alias("coverage"))


