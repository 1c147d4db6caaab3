"""Operators 11 to 13 against plain numpy and the library."""

import hashlib
import math
import pickle

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import centroids, codes, pieces
from weftline.llm.vectors import LIMIT, in_fixed_point, joined

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lloyd(x, c, rounds):
    """Plain Lloyd: assignments, squared distances and centroids, all exact."""
    for i in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if i < rounds:
            c = np.array([x[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return a, d[np.arange(len(x)), a], c


def vector_rows(n=300, dims=64, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims))
    x = (middle[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)
    x[7], x[8], x[9] = x[3], x[3], 0  # equal vectors, and one at zero
    return x


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string, x string")


BAD = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [1.0] * 63 + [math.nan]), (906, [math.inf] + [1.0] * 63)]


def test_clusters_are_those_of_plain_lloyd(spark):
    x = vector_rows()
    ids = [i if i % 50 else None for i in range(len(x) - 1)] + [4]  # null ids and a repeated one
    rows = [(i, v.tolist(), 1, "c", "x") for i, v in zip(ids, x, strict=True)] + [(i, v, None, None, None) for i, v in BAD]
    got = centroids.cluster_vectors(frame(spark, rows).repartition(3)).toPandas()
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"2:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), q[i].tolist()))
    a, d, c = lloyd(q, q[order[:40]], 5)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((i, int(k), int(e), int(d[a == k].sum()), int(d.sum()), hashlib.sha256(joined(c[k]).encode()).hexdigest()) for i, k, e in zip(ids, a, d, strict=True)), key=key)
    found = sorted(((None if np.isnan(r.vec_id) else int(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.itertuples()), key=key)
    assert found == want


def test_bounds_skip_distances_and_keep_ties():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (2000, 4)).astype(np.int32)  # a grid: distances tie all the time
    c = rng.integers(-3, 4, (30, 4)).astype(np.int64)
    c[5] = c[2]
    now = centroids.Round(c)
    state, taken = now.start(x), 0
    for _ in range(6):
        *state, n = now.assign(x, *state)
        taken += n
        d = ((x[:, None, :] - now.centroids[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        assert (state[1] >= np.sqrt(d[np.arange(len(x)), state[0]])).all() and (state[2] <= np.sqrt(d)).all()
        moved = np.array([x[state[0] == j].astype(int).sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else now.centroids[j] for j in range(30)])
        now = centroids.Round(moved, now.centroids)
    assert taken < 0.6 * 6 * 30 * len(x)


def test_fewer_vectors_than_centroids_and_none(spark):
    one = frame(spark, [(i, [float(i)] * 64, None, None, None) for i in (1, 2, 2)])
    got = sorted(tuple(r) for r in centroids.cluster_vectors(one).select("vec_id", "distance", "inertia").collect())
    assert got == [(1, 0, 0), (2, 0, 0), (2, 0, 0)]
    none = frame(spark, [(i, v, None, None, None) for i, v in BAD])
    assert centroids.cluster_vectors(none).columns == centroids.cluster_vectors(one).columns and centroids.cluster_vectors(none).isEmpty()
    assert codes.compress(none.limit(0)).columns == codes.compress(one).columns and codes.compress(none.limit(0)).isEmpty()


def test_components_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="or more"):
        in_fixed_point(frame(spark, [(1, [float(LIMIT)], None, None, None)]), 256, "vec_id").collect()


@pytest.mark.parametrize(("n", "dims"), [(600, 8), (40, 6)])
def test_codes_are_those_of_plain_lloyd(spark, n, dims):
    x = vector_rows(n, dims)
    labels = [None if i % 5 == 0 else i % 3 for i in range(n)]
    ids = [None if i == 11 else i // 2 for i in range(n)]
    rows = [(i, v.tolist(), k, "c", "x") for i, v, k in zip(ids, x, labels, strict=True)] + [r + (1, None, None) for r in BAD if r[0] not in (901, 902, 903)]
    got = codes.compress(frame(spark, rows).repartition(3)).toPandas()
    q = np.floor(1024 * np.pad(x, ((0, 0), (0, -dims % 4))).astype(float)).astype(np.int64)
    order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0, q[i].tolist()))[:256]
    width, code, error, books = q.shape[1] // 4, [""] * n, np.zeros(n, dtype=np.int64), []
    for p in range(4):
        part = q[:, p * width : (p + 1) * width]
        a, d, c = lloyd(part, part[order], 4)
        code, error, books = [s + f"{k:02x}" for s, k in zip(code, a, strict=True)], error + d, [*books, c]
    by_label = {k: sum(e for e, m in zip(error, labels, strict=True) if m == k) for k in set(labels)}
    digest = hashlib.sha256(joined(np.array(books)).encode()).hexdigest()
    want = sorted((-1 if i is None else i, c, int(e), int(by_label[k]), digest) for i, c, e, k in zip(ids, code, error, labels, strict=True))
    assert sorted((-1 if np.isnan(r.vec_id) else int(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.itertuples()) == want


def test_only_changed_parts_are_shuffled(spark):
    rows = spark.createDataFrame([([1, 2], b"\0\1", b"\0\0"), ([3, 4], b"\1\1", b"\1\1"), ([5, 6], b"\1\0", None)], "x array<int>, code binary, before binary")
    got = sorted(tuple(r) for r in codes._changes(rows.coalesce(1), 2, 2, 1).collect())
    assert got == [(0, 1, 1, [5]), (1, 0, 0, [4]), (1, 1, 1, [2])]


TEXTS = [None, "", " ", "   ", "a", " a", "a ", "\n", "a\n\n b", "▁", "x▁y ▁ z", "\0a", "é漢😀 漢", "<s> </s> <0x0A> <unk>", "a\t\r b", "the cat", "the cat", "é   x", "z" * 200 + " " + "z" * 200, "word " * 3000, "漢" * 5000]


def expected(processor, text):
    ids = processor.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("table_bytes", [pieces.TABLE_BYTES, 60, 0])
def test_pieces_are_the_librarys(spark, table_bytes):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, own string")
    got = pieces.digests(pieces.encode(docs.repartition(3), MODEL, table_bytes))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((None if i == 3 else i // 2, *expected(processor, t)) for i, t in enumerate(TEXTS)), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert pieces.digests(pieces.encode(docs.limit(0), MODEL, table_bytes)).isEmpty()


def test_each_distinct_word_is_segmented_once(spark):
    docs = spark.createDataFrame([(i, "the cat saw\nthe  cat") for i in range(50)], "doc_id long, text string").repartition(4)
    got = {r["chunk"]: r["n"] for r in pieces.distinct_chunks(docs, MODEL).collect()}
    assert got == {" the": 50, " cat": 50, " saw": 50, "\n": 50, "the": 50, "  cat": 50}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n▁abthe.<0x>\t"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5), st.integers(1, 40))
def test_chunks_are_segmented_as_whole_texts_are(texts, window):
    model = pieces.model_of(MODEL)
    was, pieces.WINDOW = pieces.WINDOW, window
    try:
        found = [[] for _ in texts]
        for docs_of, data, starts, heads in pieces.cut_up([model.prepared(t) for t in texts], model.apart):
            ends = np.r_[starts[1:], len(data)]
            ids = model.segment([data[a:b].decode() for a, b in zip(starts, ends, strict=True)])
            table = _table(data, starts, ends, ids)
            out, to = pieces._joined_back(data, starts, ends, table.find(pieces.hashed(data, starts, ends)[0]), table, pa.array([], pa.list_(pa.int64())), docs_of, heads, model.kind)
            for k, d in enumerate(docs_of):
                found[d] += out[to[heads[k]] : to[heads[k + 1]] if k + 1 < len(heads) else len(out)].tolist()
    finally:
        pieces.WINDOW = was
    assert found == [model.processor.encode(t) for t in texts]


def _table(data, starts, ends, ids):
    keys, first = np.unique(pieces.hashed(data, starts, ends)[0], return_index=True)
    part = keys.tobytes(), np.array([len(ids[i]) for i in first], dtype="<u2").tobytes(), b"".join(ids[i].tobytes() for i in first)
    return pickle.loads(pickle.dumps(pieces.Packed([part], "<u2")))


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    """Two words are given one hash in the table; both must be joined by their text."""
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = pieces.segmented

    def clashing(chunks, path):
        return plain(chunks, path).withColumn("h", F.expr("case when chunk in (' cat', ' dog') then 7 else h end"))

    monkeypatch.setattr(pieces, "segmented", clashing)
    docs = spark.createDataFrame([(1, "the cat saw the dog"), (2, "a dog")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, MODEL).collect()}
    assert got == {i: processor.encode(t, add_eos=True) for i, t in ((1, "the cat saw the dog"), (2, "a dog"))}
