"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, fingerprint, jaccard, langid, lines, packing, sharding, toxicity, urls, warc
from weftline.llm.queries import QUERIES

CLASH = ["w", "n", "s", "g", "fp", "rep", "score", "lang_pred", "_th", "_host", "range", "slot"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = words(rng, 60)
    out = [(0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t", None, None, 3), (3, base, "en", "a", len(base)), (4, base, "en", "a", len(base)), (4, base, "en", "a", len(base)), (5, base.upper(), "en", "b", 0), (6, base + " x", "de", "b", 0), (None, base, "de", "b", 0), (7, words(rng, 30_000), "en", "c", 0), (8, "zz", "en", None, 0), (9, "ÀÉ ß 漢字 a😀b", "fr", "c", 0)]
    return out + [(10 + i, words(rng, rng.randint(1, 90)), "en", "d", 0) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit(7))
    return df.cache()


@pytest.fixture(scope="module")
def bench(spark, rows):
    w = rows[3][1].split()
    return spark.createDataFrame([(1, " ".join(w[5:30])), (2, "zz"), (3, None), (4, ""), (10, " ".join(w[20:40])), (11, "p q r s t u")], "item_id long, text string")


def as_set(df):
    return Counter(map(tuple, df.collect()))


# --- sharding


def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 1009 * 0.15
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 7)


def test_table_fills_by_turns():
    names, size = ["x", "y", "z"], 13
    claims, at = {}, dict.fromkeys(names, 0)
    prefs = {}
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        o, k = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:16], "little") % (size - 1) + 1
        prefs[n] = [(o + j * k) % size for j in range(size)]
    while len(claims) < size:
        for i, n in enumerate(names):
            if len(claims) == size:
                break
            while prefs[n][at[n]] in claims:
                at[n] += 1
            claims[prefs[n][at[n]]] = i
    assert sharding.fill_table(names, size) == [claims[i] for i in range(size)]


def test_assign_shards_edges(spark, docs):
    names = [f"s{i}" for i in range(5)]
    out = sharding.assign_shards(docs, "doc_id", names, 101)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "shard"}
    assert out.groupBy("doc_id").agg(F.countDistinct("shard").alias("k")).where("k > 1").isEmpty()
    assert sharding.assign_shards(docs.limit(0), "doc_id", names, 101).count() == 0


# --- fingerprints


def test_compare_edited(spark, docs, rows):
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprint.compare_edited(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    for i, r in enumerate(order):
        t, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        g = got[r[0], len(t)]
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        if edited == t:
            assert g["edited_fingerprint"] == g["fingerprint"]
    assert got[3, len(rows[3][1])]["fingerprint"] == got[4, len(rows[3][1])]["fingerprint"] == got[5, len(rows[3][1])]["fingerprint"]
    assert fingerprint.compare_edited(docs.limit(0)).count() == 0


def test_fingerprints_are_brute_force(spark):
    """Signed votes of five-word terms, bit by bit; Spark hashes the terms."""
    rng = random.Random(9)
    texts = [words(rng, rng.randint(0, 40)) for _ in range(25)] + [None, "One, two!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = lambda t: [x for x in re.split(r"[^a-z0-9]+", (t or "").lower()) if x]
    terms = lambda t: [tuple(split(t)[i : i + 5]) for i in range(max(1, len(split(t)) - 4))]
    edited = lambda i: (texts[i] or "")[: len(texts[i] or "") - len(texts[i] or "") // 2] + (texts[i - 1] or "")[: len(texts[i] or "") // 2]
    every = sorted({x for i, t in enumerate(texts) for x in terms(t) + terms(edited(i))})
    cols = [F.get("t", F.lit(j)) for j in range(5)]
    known = {tuple(r["t"]): r["h"] & (1 << 64) - 1 for r in spark.createDataFrame([(list(x),) for x in every], "t array<string>").select("t", F.xxhash64(*cols).alias("h")).collect()}

    def fp(text):
        votes = [sum(1 if known[x] >> b & 1 else -1 for x in terms(text)) for b in range(64)]
        return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"

    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
    radius = 24
    for r in fingerprint.compare_edited(df, radius=radius).collect():
        i = r["doc_id"]
        own, other = fp(texts[i]), fp(edited(i))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other)
        assert (r["near_edited"], r["near_next"]) == (like(own, other), like(own, fp(texts[i - 1])))
        assert r["n_near"] == sum(like(own, f) >= 1 - radius / 64 for f in {fp(t) for t in texts} - {own})


def test_next_document_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_A_RANGE", 5)
    df = spark.createDataFrame([(i * i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprint._with_next(df).collect()}
    assert len(got) == 40
    assert all(got[i * i] == f"text number {i - 1 if i else 39}" for i in range(40))


def test_halves_alike_more_than_strangers(spark):
    r = fingerprint.compare_edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > r[1] + 0.1


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_near_fingerprints_are_all_pairs(spark, radius):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps] + fps[:3]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), 8)) for f in fps[:10]]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    members, pairs = fingerprint.near_fingerprints(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), radius)
    got = {(r["fp_a"], r["fp_b"], r["distance"]) for r in pairs.collect()}
    kinds = sorted(set(signed))
    want = {(a, b, (a ^ b & (1 << 64) - 1 if False else bin((a ^ b) & (1 << 64) - 1).count("1"))) for i, a in enumerate(kinds) for b in kinds[i + 1 :]}
    assert got == {w for w in want if w[2] <= radius} and members.count() == len(fps)


# --- packing


def test_packing_is_exact_and_tight(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    got = packing.pack_documents(docs, path, capacity=256).collect()
    plain = Tokenizer.from_file(path)
    want = Counter()
    for r in rows:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[r[0], k // 256, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    check_sequences(got, 256)
    total = sum(g["length"] for g in got)
    assert len({g["sequence_id"] for g in got}) <= -(-total // 256) + 2
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def check_sequences(got, capacity):
    by = defaultdict(list)
    for g in got:
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_over_blocks(spark):
    import public_tokenizers

    rng = random.Random(3)
    df = spark.createDataFrame([(i, words(rng, rng.randint(1, 60))) for i in range(400)], "doc_id long, text string")
    got = packing.pack_documents(df, public_tokenizers.path(packing.TOKENIZER), capacity=128, block=50).collect()
    check_sequences(got, 128)
    assert len({g["sequence_id"] for g in got}) <= 1.03 * sum(g["length"] for g in got) / 128 + 4


@pytest.mark.parametrize("key", ["1", "cast(null as bigint)"])
def test_blocks_are_even_whatever_the_keys(spark, key):
    """200,000 pieces that are equal in every column."""
    n, block = 200_000, packing.BLOCK
    pieces = packing.cut(spark.range(0, n, 1, 5).selectExpr(f"{key} as doc_id", "0 as piece", "0L as start", "64L as length", "9L as ids_crc32"))
    blocks = -(-n // block)
    sizes = [r["count"] for r in packing._dealt(pieces, blocks).groupBy("_block").count().collect()]
    assert len(sizes) == blocks and sum(sizes) == n and max(sizes) <= block and max(sizes) - min(sizes) <= 1


def test_packing_repeats_of_one_row_over_blocks(spark):
    import public_tokenizers

    df = spark.createDataFrame([(None if i % 2 else 7, "one two three") for i in range(600)], "doc_id long, text string")
    got = packing.pack_documents(df, public_tokenizers.path(packing.TOKENIZER), capacity=64, block=100).collect()
    check_sequences(got, 64)
    assert len(got) == 600 and len({g["sequence_id"] for g in got}) == -(-600 // (64 // got[0]["length"]))


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 21, 60)
    bins, offsets = packing.pack(sizes, 20)
    gaps, count = {}, Counter()
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])

        def cost(gap, s=s):
            after = count.copy()
            if gap is not None:
                after[gap] -= 1
            left = (20 if gap is None else gap) - s
            if left:
                after[left] += 1
            return sum(v * v for v in after.values())

        options = [g for g in count if count[g] > 0 and g >= s] + [None]
        b = int(bins[i])
        taken = gaps.get(b)
        assert cost(taken) == min(map(cost, options))
        assert offsets[i] == 20 - (20 if taken is None else taken)
        if taken is not None:
            count[taken] -= 1
        gaps[b] = (20 if taken is None else taken) - s
        if gaps[b]:
            count[gaps[b]] += 1


def test_word_cache_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path, cached=5)
    texts = ["It's ab' ab's don\x1ct ÀÉ ΑΣ ʼn 12ab.. c.\u0301 e\u0301a\u00a0\u2003z a_b ab_ ab__c", "x <|endoftext|> y", "", "  ", "한국 各国 a.b,c $$$ it'll' İstanbul", "the The THE. (the), [x]"] * 2
    assert [x.tolist() for x in own.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


# --- lines


@pytest.mark.parametrize("limit", [lines.BROADCAST_LINES, 0])
def test_line_dedup_is_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(30)] + ["", "  "]
    rows = [(i, None if i % 17 == 0 else "\n".join(rng.choice(pool[: 8 if rng.random() < 0.3 else 32]) + " " * rng.randint(0, 2) for _ in range(rng.randint(0, 6))), rng.choice(["a", "b", None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    got = {r["doc_id"]: (r["text"], r["cut"], r["n"]) for r in lines.dedup_lines(df, ratio=0.1, least=3, dropped="cut").collect()}
    different = {(r[2] or "", r[1] or "") for r in rows}
    pages, seen = Counter(s for s, _ in different), Counter()
    for s, t in different:
        seen.update({(s, x.strip()) for x in t.split("\n") if x.strip()})
    bad = {k for k, v in seen.items() if v >= 3 and v > 0.1 * pages[k[0]]}
    assert bad
    for i, t, s, n in rows:
        kept = None if t is None else [x for x in t.split("\n") if (s or "", x.strip()) not in bad]
        assert got[i] == (None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept), n)


def test_line_dedup_edges(docs):
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.dedup_lines(docs.limit(0)).count() == 0


# --- Jaccard join


def brute_groups(rows, size, percent):
    sets = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [jaccard.FAMILY, 300, 40])
@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_groups_are_brute_force(spark, docs, rows, size, percent, limit):
    rng = random.Random(size * percent)
    more = []
    for f in range(4):
        base = words(rng, rng.choice([6, 40, 120])).split()
        for k in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = words(rng, 1)
            more.append((1000 + 100 * f + k, " ".join(w[rng.randint(0, 1) :])))
    df = docs.select("doc_id", "text", "rep").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("rep", F.lit(1)))
    got = jaccard.near_groups(df, size, percent, limit).collect()
    want = brute_groups([(r[0], r[1]) for r in rows] + more, size, percent)
    assert len(got) == df.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_drop_near_copies(docs, rows):
    out = jaccard.drop_near_copies(docs)
    assert out.columns == docs.columns
    want = brute_groups([(r[0], r[1]) for r in rows], 5, 80)
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(i for i, c in want.items() if i == c)
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_drop_near_copies_keeps_null_ids_and_other_texts(spark):
    given = [(None, "alpha beta"), (None, "gamma delta"), (None, None), (None, "alpha beta"), (1, "one two three"), (1, "one two three"), (1, "quite another text"), (2, "four five")]
    out = jaccard.drop_near_copies(spark.createDataFrame(given, "doc_id long, text string"))
    assert as_set(out) == Counter(given) - Counter([(1, "one two three")])


def brute_rows(rows, size, percent):
    """Component of each row: rows are vertices of their own, those of one id too; rows without words or id stand alone."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_a_row_near_nothing_stays_whatever_its_id_has_besides(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 40) for _ in range(3))
    given = [(1, a), (5, a + " more"), (5, b), (7, c), (None, b + " more"), (None, c), (None, c)]
    out = jaccard.drop_near_copies(spark.createDataFrame(given, "doc_id long, text string"))
    assert as_set(out) == Counter([(1, a), (5, b), (7, c), (None, b + " more"), (None, c), (None, c)])


@pytest.mark.parametrize("limit", [jaccard.FAMILY, 60])
def test_ids_with_several_texts_are_brute_force(spark, limit):
    rng = random.Random(limit)
    given = []
    for _ in range(8):
        base = words(rng, rng.choice([8, 30, 90])).split()
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            given.append((rng.randint(1, 30), " ".join(w)))
    given += [given[3], (given[4][0], given[4][1].upper()), (2, None), (2, ""), (2, None)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    label = brute_rows(given, 4, 85)
    least = {}
    for (i, _), k in zip(given, label, strict=True):
        least[k] = min(i, least.get(k, i))
    got = jaccard.near_groups(df, 4, 85, limit)
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == Counter((i, least[k]) for (i, _), k in zip(given, label, strict=True))
    kept = jaccard.drop_near_copies(df, 4, 85).collect()
    full = [(i, k) for (i, t), k in zip(given, label, strict=True) if (t or "").split()]
    assert Counter(r["doc_id"] for r in kept if (r["text"] or "").split()) == Counter({k: i for i, k in sorted(full, reverse=True)}.values())
    assert Counter((r["doc_id"], r["text"]) for r in kept if not (r["text"] or "").split()) == Counter([(2, None), (2, "")])


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = words(random.Random(1), 3000)
    whole = jaccard.shingles(text, 4)
    monkeypatch.setattr(jaccard, "LONG", 500)
    assert (jaccard.shingles(text, 4) == whole).all()


# --- decontamination


def brute_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, ids = low(t), set(), set()
        for k, u in items:
            v = low(u)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_GRAMS, 0])
def test_contamination_is_brute_force(spark, docs, bench, rows, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    extra = [(50, "p q r s t u p q-r s t u"), (51, "P,Q r S t U zz ZZ"), (52, "a" * 50 + " zz")]
    df = docs.select("doc_id", "text", "w", "n").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumns({"w": F.lit(1), "n": F.lit(1)}))
    small = [(i, t) for i, t, *_ in rows if i != 7]
    got = as_set(decontaminate.contamination(df.where("doc_id is null or doc_id <> 7"), bench).drop("_th"))
    assert got == Counter(brute_contamination(small + extra, [(r["item_id"], r["text"]) for r in bench.collect()]))


def test_drop_contaminated_and_spans(spark, docs, bench, rows):
    bad = {r[0] for r in brute_contamination([(i, t) for i, t, *_ in rows if i != 7], [(r["item_id"], r["text"]) for r in bench.collect()]) if r[5]}
    out = decontaminate.drop_contaminated(docs.where("doc_id is null or doc_id <> 7"), bench)
    assert out.columns == docs.columns and not bad & {r["doc_id"] for r in out.collect()} and out.count() == sum(r[0] not in bad and r[0] != 7 for r in rows)
    spans = decontaminate.remove_spans(docs, bench)
    assert spans.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in spans.collect()}
    w = rows[3][1].split()
    assert texts[3].split() == w[:5] + w[40:] and texts[0] is None and texts[1] == "" and texts[7] == rows[9][1]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


# --- WARC


def test_warc_round_trip(spark):
    page = "<p>" + "é" * 60
    rows = [(5, "http://a/x y\n", page, 1), (3, None, page, 1), (9, "", page, 1), (7, "u", None, 1), (8, "u", "", 1), (2, "u", "small", 1), (1, "u", "small", 1), (11, "u", "z" * 300_000, 1), (None, "u", "gone", 1), (None, "v", page, 1), (None, None, "q" * 200, 1), (None, "w", "q" * 200, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    every = warc.round_trip(spark, df).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert Counter((r["payload_digest"], r["record_type"], r["refers_to"]) for r in every if r["page_id"] is None) == Counter([(sha("gone"), "response", None), (sha(page), "revisit", 3), *[(sha("q" * 200), "response", None)] * 2])
    got = {r["page_id"]: r for r in every if r["page_id"] is not None}
    assert set(got) == {1, 2, 3, 5, 7, 8, 9, 11}
    for i, _, html, _ in rows[:-4]:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {5: 3, 9: 3}
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_revisits_follow_the_digest(spark):
    a, b = "a" * 200, "b" * 200
    rows = [(1, "u", a), (2, "u", b), (5, "u", a), (5, "u", b), (5, "u", "c" * 200), (5, "u", "short")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "payload_digest", "record_type", "refers_to")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, sha(a), "response", None), (2, sha(b), "response", None), (5, sha(a), "revisit", 1), (5, sha(b), "revisit", 2), (5, sha("c" * 200), "response", None), (5, sha("short"), "response", None)]
    assert as_set(got) == Counter(want)


def test_warc_members(tmp_path):
    import gzip
    import io

    records = [warc.build_record(i, "u", b"x" * i * 50_000, hashlib.sha256(b"x" * i * 50_000).hexdigest(), None) for i in range(9)]
    mono = gzip.compress(b"".join(records[:4])) + gzip.compress(b"".join(records[4:]))
    assert list(warc.split_records(warc.inflate(io.BytesIO(mono), 1000))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[3][:-10]])))


# --- language ID


def test_language_id(spark, docs):
    out = langid.identify_held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = out.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    edge = {r["doc_id"]: r for r in langid.identify_held_out(docs).collect()}
    assert edge[0]["lang_pred"] == edge[1]["lang_pred"] == edge[2]["lang_pred"] == "und" and edge[0]["score"] == 0
    assert edge[3]["lang_pred"] != "und" and 0 <= edge[3]["score"] <= 1
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert langid.identify_held_out(docs.limit(0)).count() == 0


def test_folded_matrix_is_the_kernel_machine():
    """Kernel, landmarks, whitening and ridge in plain numpy on sets of hashes, text by text."""
    rng = random.Random(4)
    known = [("en", "the cat sat on a mat"), ("fr", "le chat noir et la nuit"), ("de", "der hund und das haus"), ("es", "la casa del perro")]
    given = [(lang, text + " " + words(rng, 3)) for lang, text in known * 6]
    asked = ["the mat", "le chat", "das haus", "casa", "x"]

    def grams(text):
        x = np.zeros(langid.HASHES, dtype=np.uint8)
        langid.presence(text, x)
        return x, set(np.flatnonzero(x).tolist())

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    rows = [(lang, np.packbits(grams(t)[0]).tobytes()) for lang, t in given]
    sets, languages = [grams(t)[1] for _, t in given], sorted({x for x, _ in given})
    marks = [s for x in languages for s in [s for s, (lang, _) in zip(sets, given, strict=True) if lang == x][: langid.LANDMARKS_A_LANGUAGE]]
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # of the landmarks' kernel, inverted
    phi = np.array([[kernel(s, m) for m in marks] for s in sets]) @ root
    weight = np.diag([1 / sum(x == lang for x, _ in given) for lang, _ in given])
    want = np.zeros((len(asked), len(languages)))
    for k, x in enumerate(languages):  # one against the rest
        y = np.array([1.0 if lang == x else -1.0 for lang, _ in given])
        w = np.linalg.solve(phi.T @ weight @ phi + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ weight @ y)
        want[:, k] = np.array([[kernel(grams(t)[1], m) for m in marks] for t in asked]) @ root @ w
    names, score = langid.fit(rows).scores([*asked, None, "123"])
    assert names == [languages[k] for k in want.argmax(axis=1)] + ["und", "und"]
    assert np.allclose(score[: len(asked)], np.clip((1 + want.max(axis=1)) / 2, 0, 1), atol=1e-4) and not score[len(asked) :].any()


# --- toxicity


@pytest.mark.parametrize("common", [0.1, 1])
def test_block_max_search_is_exact(common):
    rng = np.random.default_rng(2)
    weight = rng.random(40) + 0.5
    vectors = [toxicity.weighted(np.unique(rng.integers(0, 40, rng.integers(0, 9)), return_counts=True), weight) for _ in range(500)]
    index = toxicity.BlockMaxIndex(vectors, 40, block=16, common=common)
    assert sorted(index.order) == list(range(500))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    own, others = index.nearest(vectors[:60], 15), index.nearest(vectors[:60], 15, leave=list(range(60)))
    for q in range(60):
        for leave, (ids, cos) in ((-1, own[q]), (q, others[q])):
            full = dense @ dense[q]
            if leave >= 0:
                full[q] = -1
            want = np.lexsort((np.arange(500), -np.round(full, 12)))[:15]
            assert ids.tolist() == want[full[want] > 0].tolist() and np.allclose(cos, full[ids])


def test_scores_are_brute_force(spark):
    """Every text's score from plain cosines over all words of all examples."""
    rng = random.Random(11)
    texts = [words(rng, rng.randint(0, 30)) + (" foul" if i % 5 == 0 else "") for i in range(120)] + [None, "", "12 34", "foul"] + ["same same text"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"score": F.lit(1), "toxic": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 90)] + [(121, 0), (None, 1), (4000, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_held_out(docs, labels).collect()}
    split = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    train = [i for i in [*range(90), 121] if zlib.crc32(str(i).encode()) % 3 != 1]
    y = {i: float(i % 5 == 0 and i < 90) for i in train}
    df = Counter(w for t in texts for w in split(t))
    n1, n0 = sum(y.values()), len(train) - sum(y.values())
    weight = {}
    for w in set().union(*[split(texts[i]) for i in train]):
        a, b = (sum(w in split(texts[i]) for i in train if y[i] == v) for v in (1, 0))
        p = (a + b + 1) / (len(train) + 2)
        weight[w] = (np.log((len(texts) + 1) / (df[w] + 1)) + 1) * max(1, (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))

    def vector(t):
        v = {w: (1 + np.log(k)) * weight[w] for w, k in split(t).items() if w in weight}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    example = {i: vector(texts[i]) for i in train}

    def vote(v, leave=None):
        cos = sorted(((-round(sum(x * e.get(w, 0) for w, x in v.items()), 12), i) for i, e in example.items() if i != leave))
        near = [(-c, i) for c, i in cos[: toxicity.NEIGHBOURS] if c < 0]
        w = [1 / (1.05 - min(c, 1)) for c, _ in near]
        return (sum(a * y[i] for a, (_, i) in zip(w, near, strict=True)) / sum(w) if near else None), [i for _, i in near[:3]]

    own = {i: vote(example[i], i)[0] for i in train}
    stands = {i: (n1 + (zlib.crc32(b"4000") % 3 != 1)) / n1 if y[i] else 1.0 for i in train}  # a label without a text counts
    some = [i for i in train if own[i] is not None]
    knots, values = toxicity.isotonic(*(np.array([of[i] for i in some]) for of in (own, y, stands)))
    bare = [i for i in train if own[i] is None]
    none = (sum(y[i] * stands[i] for i in bare) + sum(y[i] * stands[i] for i in train) / sum(stands.values())) / (sum(stands[i] for i in bare) + 1)
    for i, t in enumerate(texts):
        v, evidence = vote(vector(t))
        assert got[i]["score"] == pytest.approx(none if v is None else np.interp(v, knots, values), abs=1e-6), i
        assert got[i]["evidence"] == evidence and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_words_of_long_texts(monkeypatch):
    text = words(random.Random(1), 3000) + " ÀÉ ß漢字a😀b x1y_z"
    whole = toxicity.words_of(text)
    assert whole[1].sum() == 3000 + len(re.findall(r"[^\W\d_]+", "ÀÉ ß漢字a😀b x1y_z"))
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert all((a == b).all() for a, b in zip(toxicity.words_of(text), whole, strict=True))
    assert len(toxicity.words_of(None)[0]) == len(toxicity.words_of("1 _")[0]) == 0


def test_toxicity(spark, docs):
    d = "/root/testdata/sf0.1/"
    documents, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    found = toxicity.score_held_out(documents, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out")
    got = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert got[1, 1] >= 0.85 * (got[1, 1] + got[1, 0]) and got.get((0, 1), 0) <= 0.005 * got[0, 0]
    few = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    edge = toxicity.score_held_out(docs, few)
    assert edge.count() == docs.count() and edge.where("score is null or score < 0 or score > 1").isEmpty()
    assert len({r["score"] for r in edge.where("doc_id in (3, 4, 5)").collect()}) == 1
    assert toxicity.score_held_out(docs, few.limit(0)).where("score <> 0").isEmpty()
    assert toxicity.score_held_out(docs.limit(0), few.limit(0)).count() == 0


# --- urls


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    given = [None, "", "no scheme", "http://A.Example.NET/en/1?x", "https://example.net/en/", "http://example.net/EN/", "http://net", "http://anet/", "ftp://x.example.com/de/7#top", "http://example.com/de", "http://b.org/fr/x", "http://org/fr/", "http://xorg/fr/1", "a://b://c/d", "http://h?q/x", "http://É.com/a\nb"]
    given += [f"http://q.com/{'bad' if i % 2 else 'good'}/{i}" for i in range(40)]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(given)], "page_id long, url string, label string")
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for i, u in enumerate(given):
        host, path = brute_host_path(u)
        fit = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        best = max(fit, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best), u
        assert got[i]["verdict"] == rules.get(best, got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_templates_split_by_purity(spark):
    rows = [("h", f"/{k}/{i}", 1 if k == "bad" else 0) for k in ("bad", "good") for i in range(60)] + [("h", f"/bad/{i}x", None) for i in range(1000, 1009)]
    rows += [("m", f"/{k}/{i}", i % 2) for k in ("u", "v") for i in range(60)]
    got = {(r["host"], "/".join(r["raw"])): r for r in urls.templates(spark.createDataFrame(rows, "host string, path string, label int")).collect()}
    assert got["h", "bad/*"]["template"] == "/bad/**" and got["h", "bad/*"]["purity"] > 0.9
    assert got["h", "good/*"]["purity"] < 0.2
    assert got["m", "u/*"]["template"] == got["m", "v/*"]["template"] == "/*/*"


@pytest.mark.parametrize("times", [1, 60])
def test_branches_without_labels_are_judged_alike_at_any_size(spark, times):
    hosts = {"a.example.com": ("de", "en", "fr"), "b.example.com": ("de", *[f"rare-{chr(97 + i)}" for i in range(20)])}
    given = [f"http://{h}/{s}/{'x' if s == 'de' else 'y'}" for h, names in hosts.items() for s in names for _ in range(30 if h[0] == "a" and s != "de" else 3)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given * times)], "page_id long, url string")
    got = urls.judge_urls(df)
    assert got.where("rule is null and verdict = 'block'").isEmpty()
    assert got.where("rule is not null and verdict = 'allow'").isEmpty()


def brute_verdicts(given):
    """The tree in plain Python, host by host."""
    judged = [(*brute_host_path(u), *(r := urls_rule(*brute_host_path(u)))) for u in given]
    label = {"block": 1, "allow": 0, None: None}
    counts = [label[v] for *_, v in judged if v]
    prior = min(0.5, (sum(counts) + 1) / (len(counts) + 2))
    purity = {}

    def grow(rows, level, p, where):
        """rows: (segments, labels) of the raw paths below a node."""
        below = defaultdict(list)
        for seg, ys in rows:
            if len(seg) == level:
                purity[where, seg] = p
            else:
                below[seg[level]].append((seg, ys))
        every = [x for part in below.values() for x in part]
        n_all = sum(len(ys) for _, ys in every)
        if n_all < urls.LEAST or len(every) == 1:
            purity.update({(where, seg): p for seg, _ in every})
            return
        known = lambda part: [y for _, ys in part for y in ys if y is not None]
        parts = defaultdict(list)
        for s, part in below.items():
            n, mine = sum(len(ys) for _, ys in part), known(part)
            others = [y for t, x in below.items() if t != s for y in known(x)]
            differs = bool(mine) != bool(others)
            if mine and others:
                pooled = sum(mine + others) / len(mine + others)
                differs = abs(sum(mine) / len(mine) - sum(others) / len(others)) > urls.SIGNIFICANT * (pooled * (1 - pooled) * (1 / len(mine) + 1 / len(others))) ** 0.5
            parts[s if n >= urls.LEAST and n >= urls.RARE * n_all and differs and s != "*" else "*"].append((s, part))
        for kids in parts.values():
            ys = [y for _, part in kids for y in known(part)]
            bare = sum(len(y) for _, part in kids if not known(part) for _, y in part)
            q = (sum(ys) + 10 * (p if ys else min(p, prior))) / (len(ys) + bare + 10)
            grow([x for _, part in kids for x in part], level + 1, q, where)

    hosts = defaultdict(lambda: defaultdict(list))
    seg_of = lambda path: tuple("*" if re.match(urls.VARIABLE, x) else x for x in path.split("/") if x)
    for host, path, _, v in judged:
        hosts[host][seg_of(path)].append(label[v])
    for host, rows in hosts.items():
        ys = [y for x in rows.values() for y in x]
        grow(list(rows.items()), 0, (sum(y or 0 for y in ys) + 10 * prior) / (len(ys) + 10), host)
    return [v or ("block" if purity[host, seg_of(path)] >= urls.REJECT else "allow") for host, path, _, v in judged], [purity[h, seg_of(p)] for h, p, *_ in judged]


def urls_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_are_brute_force(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.example.com", "x.net", "b.org", "c.example.net", "plain.io"]
    names = ["de", "fr", "en", "shop", "*", "**", "2024", "x"]
    given = [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    given += [f"http://a.example.com/de/{'deep/' * 12}{i % 3}" for i in range(30)] + [f"http://y.example.com/{'de' if i % 2 else 'de-at'}/{i}" for i in range(80)]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    verdicts, purity = brute_verdicts(given)
    for i, u in enumerate(given):
        assert got[i]["verdict"] == verdicts[i] and got[i]["purity"] == pytest.approx(purity[i]), u


@pytest.mark.parametrize("times", [5, 20])
def test_verdicts_of_repeated_pages(spark, times):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    many = pages.crossJoin(spark.range(times)).select("page_id", "url")
    changed = urls.judge_urls(many).join(urls.judge_urls(pages).select("page_id", F.col("verdict").alias("v")), "page_id")
    assert changed.where("verdict <> v").isEmpty()


# --- registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns, name
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "near_duplicates":
            assert now == {i for i, c in brute_groups(rows, 5, 80).items() if i == c}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert now == ids - {r[0] for r in brute_contamination(rows, items) if r[5]}
        if name == "line_dedup":
            assert now == ids
        docs, ids = out, now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_sequences(packed, 4096)
    assert {p["doc_id"] for p in packed} == ids


def test_pipeline_on_nulls_repeats_and_empty_tables(spark, sf_dir, docs, rows, bench, tmp_path):
    import corpus_pipeline

    learn = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id between 1000 and 1060")
    for c in CLASH:
        learn = learn.withColumn(c, F.lit(7))
    clash = docs.unionByName(learn).withColumns({c: F.lit("x") for c in ("component_id", "sequence_id", "offset", "rn", "n_hit", "piece")})
    kept = {}
    for name, table in (("full", clash), ("empty", clash.limit(0))):
        folder = tmp_path / name
        table.write.parquet(f"{folder}/documents.parquet")
        bench.limit(0 if name == "empty" else 6).write.parquet(f"{folder}/benchmark.parquet")
        current = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, current, str(folder)).cache()
            assert out.columns == clash.columns, stage
            kept[name, stage] = Counter((r["doc_id"], r["text"]) for r in out.collect())
            assert stage == "line_dedup" or not kept[name, stage] - Counter((r["doc_id"], r["text"]) for r in current.collect()), stage
            current = out
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        check_sequences(packed, 4096)
        assert Counter({p["doc_id"] for p in packed}) == Counter({i for i, _ in kept[name, "decontamination"]})
    first = kept["full", "language_id"]
    assert not any(not t or not any(c.isalpha() for c in t) for _, t in first) and first[(4, rows[3][1])] == 2
    assert not any(kept["empty", s] for s, _ in corpus_pipeline.STAGES[:-1])
    near = kept["full", "near_duplicates"]
    assert (3, rows[3][1]) in near and (None, rows[3][1]) in near and not {4, 5, 6} & {i for i, _ in near}
