"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of the labelled texts, and the terms are all their words. A
term weighs (1 + log tf) * idf, its document frequency being counted over the whole corpus,
times a factor of at least 1: by how many standard errors its document rates differ between
the two labels. No term or example is left out; the factor keeps a handful of telling words
from drowning in a long text. The index holds, for each term, postings in blocks of examples
with the block's largest weight; examples are ordered by similarity, so that a block's maxima
say something, and terms of many examples are dense rows. A query bounds every block by the
block's best dense part and its other terms' maxima, scores the most promising blocks, then all
whose bound reaches the k-th best cosine found, so the neighbours are exact.
Their distances weigh their votes; an isotonic map, fitted on the examples' own leave-one-out
votes and weighted to the labelled rows' base rate, turns votes into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fold, let_go

#: At most this many labelled rows of each label are used to fit, chosen by hash of doc_id.
SAMPLE_A_LABEL = 3000
NEIGHBOURS = 15
EVIDENCE = 3
BLOCK = 128  # examples
COMMON = 1 / 6  # terms of a larger share of the examples are dense rows
FIRST = 3  # blocks scored before any is ruled out
BATCH = 64  # texts scored at once
REPORT_AT = 0.7
PIECES = 16  # that a task's document frequencies are sent in
PIECE = 1 << 20  # code points hashed at once

Vector = tuple[np.ndarray, np.ndarray]  # ascending terms and their counts or weights

_lower: list[np.ndarray] = []


def _lower_case() -> np.ndarray:
    """The lower case of each letter's code point, 0 for all that is no letter."""
    if not _lower:
        _lower.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32))
    return _lower[0]


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE code points that cut no run of letters."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end


def _hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, which is a run of letters in lower case."""
    codes = _lower_case()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    inside = codes > 0
    if not inside.any():
        return np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    spans = np.diff(np.r_[starts, len(codes)])
    at = np.arange(starts[0], len(codes)) - np.repeat(starts, spans)
    powers = np.r_[np.uint64(1), np.full(int(spans.max()), 0x9E3779B97F4A7C15, dtype=np.uint64)].cumprod(dtype=np.uint64)
    h = codes[starts[0] :].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = np.add.reduceat((h ^ (h >> np.uint64(32))) * powers[at], starts - starts[0])
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def words_of(text: str | None) -> Vector:
    """The hashes of a text's words, ascending, and how often each occurs."""
    found = [_hashes(p) for p in _pieces(text)] if isinstance(text, str) else []
    return np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), return_counts=True)


def counts_of(text: str | None, words: np.ndarray) -> Vector:
    """The places in `words` (ascending hashes) of a text's words, and how often each occurs."""
    found, tf = words_of(text)
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    known = words[at] == found
    return at[known], tf[known]


def weighted(counts: Vector, weight: np.ndarray) -> Vector:
    terms, tf = counts
    w = (1 + np.log(tf)) * weight[terms]
    return terms, w / np.sqrt((w * w).sum()) if len(w) else w


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1 ... start + size - 1, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def similar_order(vectors: list[Vector], terms: int, block: int) -> np.ndarray:
    """Rows in an order that brings similar ones together: parts are halved between two far rows, down to a block."""
    size = np.array([len(v[0]) for v in vectors], dtype=np.int64)
    start = np.cumsum(size) - size
    flat = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
    value = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])

    def cosines(rows: np.ndarray, to: int) -> np.ndarray:
        dense = np.zeros(terms)
        dense[vectors[to][0]] = vectors[to][1]
        at = _ranges(start[rows], size[rows])
        return np.bincount(np.repeat(np.arange(len(rows)), size[rows]), value[at] * dense[flat[at]], len(rows))

    out, parts = [], [np.arange(len(vectors))]
    while parts:
        rows = parts.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        one = int(rows[np.argmin(cosines(rows, int(rows[0])))])
        near = cosines(rows, one)
        other = int(rows[np.argmin(near)])
        rows = rows[np.argsort(cosines(rows, other) - near, kind="stable")]
        middle = block * (-(-len(rows) // block) // 2)
        parts += [rows[middle:], rows[:middle]]
    return np.concatenate(out or [np.zeros(0, np.int64)])


class BlockMaxIndex:
    """For each term, its entries: blocks of examples with their postings and the largest weight among them.

    Terms that many examples hold are kept as dense rows instead, one matrix product for a
    batch of queries; a block's bound is then its best dense part plus its entries' maxima.
    """

    def __init__(self, vectors: list[Vector], terms: int, block: int = BLOCK, common: float = COMMON):
        self.size, self.block, self.blocks = len(vectors), block, -(-len(vectors) // block)
        self.order = similar_order(vectors, terms, block)  # number of the example at each place
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, np.int64)])
        value = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        place = np.repeat(np.arange(self.size), [len(vectors[i][0]) for i in self.order])
        many = np.bincount(term, minlength=terms) > common * self.size
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.dense = np.zeros((int(many.sum()), self.blocks * block))
        often = many[term]
        self.dense[self.row[term[often]], place[often]] = value[often]
        term, value, place = term[~often], value[~often], place[~often]
        by = np.argsort(term, kind="stable")  # by term, then place
        term, self.place, self.value = term[by], place[by], value[by]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.place[1:] // block != self.place[:-1] // block)]) if len(term) else np.zeros(0, np.int64)
        self.posts = np.r_[first, len(term)]  # where an entry's postings begin
        self.held = self.place[first] // block  # an entry's block
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(terms + 1))  # where a term's entries begin

    def nearest(self, queries: list[Vector], k: int, leave: list[int] | None = None) -> list[Vector]:
        """For each query up to k examples with a positive cosine, best first, ties by number; never leave[i]."""
        given = np.zeros((len(queries), len(self.dense)))
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            given[i, row[row >= 0]] = weights[row >= 0]
        part = given @ self.dense
        best = part.reshape(len(queries), self.blocks, self.block).max(axis=2, initial=0)
        left = None if leave is None else np.argsort(self.order)[leave]
        return [self._of(*query, part[i], best[i], k, -1 if left is None else left[i]) for i, query in enumerate(queries)]

    def _of(self, terms: np.ndarray, weights: np.ndarray, cos: np.ndarray, bound: np.ndarray, k: int, leave: int) -> Vector:
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        sizes = self.entries[terms + 1] - self.entries[terms]
        entry, weight = _ranges(self.entries[terms], sizes), np.repeat(weights, sizes)
        held = self.held[entry]
        bound = bound + np.bincount(held, weight * self.most[entry], self.blocks)
        untried, floor, now = bound > 0, 0.0, np.argsort(-bound, kind="stable")[:FIRST]
        while True:
            take = np.zeros(self.blocks, dtype=bool)
            take[now] = True
            take &= untried
            if not take.any():
                break
            untried &= ~take
            mine = take[held]
            e, w = entry[mine], weight[mine]
            n = self.posts[e + 1] - self.posts[e]
            at = _ranges(self.posts[e], n)
            cos = cos + np.bincount(self.place[at], np.repeat(w, n) * self.value[at], len(cos))
            if leave >= 0:
                cos[leave] = 0
            floor = np.partition(cos, -k)[-k] if len(cos) >= k else 0.0
            now = np.flatnonzero(bound >= floor - 1e-9)
        hit = np.flatnonzero((cos > 0) & (cos >= floor - 1e-9))
        best = hit[np.lexsort((self.order[hit], -np.round(cos[hit], 12)))[:k]]
        return self.order[best], cos[best]


@dataclass
class Model:
    words: np.ndarray  # hashes, ascending
    weight: np.ndarray  # of each word: idf times how much it tells
    index: BlockMaxIndex
    ids: np.ndarray
    toxic: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    none: float  # the probability where no neighbour is found

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(cos, 1.0))
        return float((w * self.toxic[near]).sum() / w.sum())

    def scores(self, counts: list[Vector]) -> Iterator[tuple[float, list[int]]]:
        for at in range(0, len(counts), BATCH):
            for near, cos in self.index.nearest([weighted(c, self.weight) for c in counts[at : at + BATCH]], NEIGHBOURS):
                if len(near):
                    yield float(np.interp(self.vote(near, cos), self.knots, self.values)), self.ids[near[:EVIDENCE]].tolist()
                else:
                    yield self.none, []


def telling(counts: list[Vector], toxic: np.ndarray, terms: int) -> np.ndarray:
    """Of each term, how many standard errors above the other label's its rate under the toxic label is; at least 1."""
    of = [np.bincount(np.concatenate([c[0] for c, y in zip(counts, toxic, strict=True) if y == label] or [np.zeros(0, np.int64)]), minlength=terms) for label in (1, 0)]
    n = [max(1, int((toxic == label).sum())) for label in (1, 0)]
    p = (of[0] + of[1] + 1) / (sum(n) + 2)
    return np.maximum(1.0, (of[0] / n[0] - of[1] / n[1]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1])))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the weighted non-decreasing fit, each block smoothed by one pseudo-count at the mean."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        blocks.append([yi * wi, wi, xi, xi])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            s, t, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + t, blocks[-1][2], hi]
    mean = float((y * w).sum() / w.sum())
    value = [(s + mean) / (t + 1) for s, t, _, _ in blocks]
    knots = np.array([e for b in blocks for e in (b[2], b[3])])
    return knots, np.maximum.accumulate(np.array([v for v in value for _ in (0, 1)]))


def sample(docs: DataFrame, labels: DataFrame, usable: Column, each: int = SAMPLE_A_LABEL) -> tuple[list[tuple[int, int, Vector]], dict[int, int]]:
    """The words of up to `each` labelled texts a label, counted where the texts lie, and the labelled rows of each label.

    Of rows with one doc_id the highest label counts.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words_of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": [w.astype("<u8").tobytes() for w, _ in found], "times": [n.astype("<i4").tobytes() for _, n in found]})

    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label, n in counts.items():
        share = int(min(1.0, 1.3 * each / n + 0.001) * (1 << 20))
        part = known.where((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= share))
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return [], counts
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInPandas(counted, "doc_id long, toxic int, words binary, times binary").collect()
    vectors = [(r["doc_id"], r["toxic"], (np.frombuffer(r["words"], dtype="<u8"), np.frombuffer(r["times"], dtype="<i4").astype(np.int64))) for r in rows]
    return sorted(vectors, key=lambda x: x[0]), counts


def document_frequencies(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each word, over every document; and the number of documents. A task sends one packed array, in pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by the sample
    each = -(-(len(words) + 1) // PIECES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        words, out = shared.value, np.zeros(each * PIECES, dtype="<i8")
        for batch in batches:
            for text in batch["text"]:
                out[counts_of(text, words)[0]] += 1
            out[len(words)] += len(batch)
        yield pd.DataFrame({"piece": range(PIECES), "n": [out[i * each : (i + 1) * each].tobytes() for i in range(PIECES)]})

    def add(piece: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(each, dtype="<i8")
        for n in piece["n"]:
            total += np.frombuffer(n, dtype="<i8")
        return pd.DataFrame({"piece": piece["piece"].iloc[:1], "n": [total.tobytes()]})

    rows = docs.select("text").mapInPandas(count, "piece int, n binary").groupBy("piece").applyInPandas(add, "piece int, n binary").collect()
    found = np.zeros(each * PIECES, dtype=np.int64)
    for r in rows:
        found[r["piece"] * each : (r["piece"] + 1) * each] = np.frombuffer(r["n"], dtype="<i8")
    return found[: len(words)], int(found[len(words)])


def fit(docs: DataFrame, rows: list[tuple[int, int, Vector]], counts: dict[int, int]) -> Model:
    toxic = np.array([r[1] for r in rows], dtype=np.float64)
    given = [r[2] for r in rows]
    words = np.unique(np.concatenate([g[0] for g in given] or [np.zeros(0, dtype=np.uint64)]))
    found = [(np.searchsorted(words, w), tf) for w, tf in given]
    df, n = document_frequencies(docs, words)
    weight = (np.log((n + 1) / (df + 1)) + 1) * telling(found, toxic, len(words))
    vectors = [weighted(c, weight) for c in found]
    model = Model(words, weight, BlockMaxIndex(vectors, len(words)), np.array([r[0] for r in rows], dtype=np.int64), toxic, np.array([0.0, 1.0]), np.array([0.0, 1.0]), 0.0)
    if not rows:
        return model
    taken = Counter(int(t) for t in toxic)
    stands = np.array([counts[int(t)] / taken[int(t)] for t in toxic])  # labelled rows that each example stands for
    votes = np.full(len(rows), np.nan)
    for at in range(0, len(rows), BATCH):
        some = list(range(at, min(at + BATCH, len(rows))))
        for i, (near, cos) in zip(some, model.index.nearest(vectors[at : at + BATCH], NEIGHBOURS, leave=some), strict=True):
            if len(near):
                votes[i] = model.vote(near, cos)
    bare = np.isnan(votes)
    base = float((toxic * stands).sum() / stands.sum())
    model.none = float(((toxic * stands)[bare].sum() + base) / (stands[bare].sum() + 1))
    if not bare.all():
        model.knots, model.values = isotonic(votes[~bare], toxic[~bare], stands[~bare])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (doc_ids of the nearest examples) of every row; texts without a word of any example have no neighbour."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        model = shared.value
        for batch in batches:
            found = list(model.scores([counts_of(t, model.words) for t in batch["text"]]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [f[0] for f in found], "evidence": [f[1] for f in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, evidence array<long>")


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; labels are learned only from rows whose crc32 fold is not `out`.

    One row for each row of docs: null and empty texts get the share of toxic ones among
    examples without a neighbour, repeated rows are scored alike, all other columns of docs are
    ignored. Without any labelled row every score is 0.
    """
    held = fold("doc_id", folds) == out
    rows, counts = sample(docs, labels, ~held)
    found = score(docs, fit(docs, rows, counts))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= REPORT_AT).cast("int").alias("predicted"), "evidence")
