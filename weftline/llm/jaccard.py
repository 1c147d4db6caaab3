"""Exact Jaccard join of word-shingle sets as a metric-space join with pivots.

Jaccard distance is a metric; texts link at distance at most 1 - threshold. Exact copies become
one representative first. Nearly all unrelated texts lie at distance 1 from each other, where
document pivots alone part nothing, so the first regions have single shingles as pivots: with
shingles ordered by corpus frequency, two linked sets share at least k(n) of their first
n - ceil(t n) + k(n), n being the smaller one's size, and sets that share fewer with all others
are settled. Inside a region, sets are compared by their distances to 64 pivots that part the
shingle universe, 512 for large sets (the counts of their shingles in each part, a lower bound
of the true distance), which leaves
families of possible neighbours. A family is joined in one task while its shingles fit a bound:
texts are visited from linked text to linked text, and only those in the triangle-inequality
window of the first pivot's distance are compared. Larger families are cut into Voronoi regions
around document pivots; sets within twice the radius of a border are replicated; regions are cut
again by pivots of their own until they fit. Sets that link to a pivot are one component with it
and are not compared with each other, so a family of thousands of near copies of one text falls
to its few sets that no pivot reaches. Regions that pivots cannot part are joined block by
block. All steps report a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Steps, cut, let_go, trim, trimmed

SHARED, SHARED_PER = 8, 32  # k(n) is SHARED + n // SHARED_PER, but no more than ceil(t n)
SKETCH_BITS = 20  # counters of the frequency order: one array of 4 MB
PARTS, WIDE, LARGE = 64, 512, 1024  # sets of LARGE shingles have WIDE parts, which fold into PARTS
#: Regions of more rows are linked whole, which only makes families larger.
REGION = 50_000
#: Shingles that one task joins at once.
FAMILY = 1 << 20
PIVOTS = 8
#: Bytes of pivots that are sent to every task at once.
PIVOT_BYTES = 32 << 20
#: Turns of cutting cells by pivots, the share of its cell that the largest part may hold, and how often all together.
TURNS, PARTED, SPREAD = 4, 0.7, 3
#: Up to this many ids (8 bytes each) are broadcast to pick the texts of families.
BROADCAST_IDS = 1_000_000
#: Up to this many rows of ids and numbers (60 bytes each) are broadcast to pick the sets of regions.
BROADCAST_ROWS = 250_000
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LONG = 1 << 20  # bytes hashed at once
_rng = np.random.default_rng(20240229)  # fixed: hashes must agree between processes
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE[SPACES] = 0
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = [np.ones(1, dtype=np.uint64)]


def _power(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        _powers[0] = np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(n, 4096) - 1, BASE)]).cumprod(dtype=np.uint64)
    return _powers[0]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased UTF-8."""
    if len(data) > LONG:
        words = data.split()
        each = max(1, len(words) * LONG // len(data))
        return np.concatenate([_hashes(b" ".join(words[i : i + each])) for i in range(0, len(words), each)] or [np.zeros(0, dtype=np.uint64)])
    return _hashes(data)


def _hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    apart = SPACES[b]
    starts = np.flatnonzero(~apart & np.r_[True, apart[:-1]]) if len(b) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    spans = np.diff(np.r_[starts, len(b)])
    at = np.arange(starts[0], len(b)) - np.repeat(starts, spans)
    return _mix(np.add.reduceat(BYTE[b[starts[0] :]] * _power(int(spans.max()))[at], starts - starts[0]))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending, as int64; of a shorter text's words as one; none without words."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    n, width = max(1, len(h) - size + 1), min(size, len(h))
    s = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        s = s * BASE + h[i : i + n] * PLACE[i % 64]
    return np.unique(_mix(s)).view(np.int64)


def digest_of(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts that are small enough to hold several times over."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _overlap(n: np.ndarray | int, percent: int):
    """The least intersection of a set of n with any it links to."""
    return -(-percent * n // 100)


def _shared(n: int, percent: int) -> int:
    """How many of the first shingles a set of n must share with one of its size or larger; ascends with n."""
    return min(SHARED + n // SHARED_PER, _overlap(n, percent))


def _bound(n: np.ndarray | int, percent: int):
    """Numerator of the largest symmetric difference of two linked sets, given n = |x| + |y|; over 100 + percent."""
    return (100 - percent) * n


def shingle_order(docs: DataFrame, size: int) -> np.ndarray:
    """Counters, by hash, of every document's shingles; only their order is used, so collisions do no harm."""
    blocks = 64
    each = (1 << SKETCH_BITS) // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in _slices(batches):
            found = [shingles(t, size) for t in batch.column(0).to_pylist()]
            total += np.bincount(np.concatenate(found).view(np.uint64) >> np.uint64(64 - SKETCH_BITS), minlength=1 << SKETCH_BITS) if found else 0
        packed = [np.minimum(total[i * each : (i + 1) * each], 0xFFFFFFFF).astype("<u4").tobytes() for i in range(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add(block: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(each, dtype=np.int64)
        for c in block["counts"]:
            total += np.frombuffer(c, dtype="<u4")
        return pd.DataFrame({"block": block["block"].iloc[:1], "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})

    rows = docs.select("text").mapInArrow(lambda b: trimmed(count(b)), "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)  # 4 MB, whatever the corpus
    for r in rows:
        out[r["block"] * each : (r["block"] + 1) * each] = np.frombuffer(r["counts"], dtype="<u4")
    return out


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, its first shingles by frequency, and counts in PARTS parts of the universe."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, size))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = order.value
        for batch in _slices(batches):
            n, digest, first, parts = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                need = _overlap(len(s), percent)
                take = len(s) - need + _shared(len(s), percent)
                by = np.argsort(counts[s.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:take]
                n.append(len(s))
                digest.append(digest_of(s))
                first.append(s[by])
                width = PARTS if len(s) < LARGE else WIDE
                parts.append(np.minimum(np.bincount(s & (width - 1), minlength=width), 255).astype(np.uint8).tobytes())
            ends = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(first) if first else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest), lists, pa.array(parts, pa.binary())], names=["doc_id", "n", "digest", "first", "parts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: trimmed(profile(b)), "doc_id long, n long, digest string, first array<long>, parts binary")


class _Parts:
    """Counts by part of many sets: all in PARTS, the large ones also in WIDE."""

    def __init__(self, narrow: np.ndarray, wide: np.ndarray, place: np.ndarray):
        self.narrow, self.wide, self.place = narrow, wide, place  # place: row in wide, or -1

    @classmethod
    def of(cls, packed: list[bytes]) -> _Parts:
        large = np.array([len(p) == WIDE for p in packed], dtype=bool)
        place = np.where(large, np.cumsum(large) - 1, -1)
        wide = np.frombuffer(b"".join(p for p in packed if len(p) == WIDE), dtype=np.uint8).reshape(-1, WIDE).astype(np.int16)
        narrow = np.zeros((len(packed), PARTS), dtype=np.int16)
        narrow[~large] = np.frombuffer(b"".join(p for p in packed if len(p) != WIDE), dtype=np.uint8).reshape(-1, PARTS)
        narrow[large] = wide.reshape(-1, WIDE // PARTS, PARTS).sum(axis=1)
        return cls(narrow, wide, place)

    def take(self, rows: np.ndarray) -> _Parts:
        return _Parts(self.narrow[rows], self.wide, self.place[rows])

    def with_more(self, other: _Parts) -> _Parts:
        mine = self.place[self.place >= 0]
        at = np.where(self.place >= 0, np.cumsum(self.place >= 0) - 1, -1)
        return _Parts(np.r_[self.narrow, other.narrow], np.r_[self.wide[mine], other.wide], np.r_[at, np.where(other.place >= 0, other.place + len(mine), -1)])

    def near(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of rows a[i], b[i] the parts and sizes n do not exclude."""
        most = _bound(n[a] + n[b], percent)
        ok = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((100 + percent) * np.abs(self.narrow[a] - self.narrow[b]).sum(axis=1, dtype=np.int64) <= most)
        both = np.flatnonzero(ok & (self.place[a] >= 0) & (self.place[b] >= 0))
        for at in range(0, len(both), 4096):
            i = both[at : at + 4096]
            apart = np.abs(self.wide[self.place[a[i]]] - self.wide[self.place[b[i]]]).sum(axis=1, dtype=np.int64)
            ok[i] = (100 + percent) * apart <= most[i]
        return ok


def _forest(n: np.ndarray, parts: _Parts, percent: int) -> np.ndarray:
    """Label of each row's component among rows whose sizes and parts do not exclude a link; n ascends."""
    label, left = np.full(len(n), -1), np.arange(len(n))
    while len(left):
        root, queue = left[0], [left[0]]
        label[root], left = root, left[1:]
        while queue and len(left):
            p = queue.pop()
            lo, hi = np.searchsorted(n[left], [-(-percent * n[p] // 100), 100 * n[p] // percent + 1])
            if lo >= hi:
                continue
            some = left[lo:hi]
            near = parts.near(some, np.full(len(some), p), n, percent)
            if near.any():
                label[some[near]] = root
                queue += some[near].tolist()
                left = np.concatenate([left[:lo], some[~near], left[hi:]])
    return label


def candidate_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) spanning the possible neighbours in each region; rows (s, rep, n, parts) come hashed and sorted by s."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None  # rows of a region that may go on, or (s, first rep) of one beyond REGION

        def out(a: list, b: list) -> pa.RecordBatch:
            a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        def solve(rep: np.ndarray, n: np.ndarray, parts: _Parts, a: list, b: list) -> None:
            order = np.lexsort((rep, n))
            label, rep = _forest(n[order], parts.take(order), percent), rep[order]
            least = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(least, label, rep)
            a.append(rep)
            b.append(least[label])

        whole: tuple[int, int] | None = None
        for batch in _slices(batches, 4096):
            s, rep, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(s):
                continue
            parts = _Parts.of(batch.column(3).to_pylist())
            if tail is not None:
                s, rep, n, parts = np.r_[tail[0], s], np.r_[tail[1], rep], np.r_[tail[2], n], tail[3].with_more(parts)
                tail = None
            a, b = [], []
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            ends = np.r_[at[1:], len(s)]
            pairs = np.flatnonzero(ends[:-1] - at[:-1] == 2)
            if len(pairs):  # most regions: all at once
                i = at[pairs]
                near = parts.near(i, i + 1, n, percent)
                a.append(rep[i[near]])
                b.append(rep[i[near] + 1])
            for lo, hi in zip(at[:-1], ends[:-1], strict=True):
                if whole is not None and whole[0] == s[lo]:
                    a.append(rep[lo:hi])
                    b.append(np.full(hi - lo, whole[1]))
                elif hi - lo > 2:
                    if hi - lo > REGION:
                        a.append(rep[lo:hi])
                        b.append(np.full(hi - lo, rep[lo]))
                    else:
                        solve(rep[lo:hi], n[lo:hi], parts.take(np.arange(lo, hi)), a, b)
            lo = at[-1]
            if whole is not None and whole[0] != s[lo]:
                whole = None
            if whole is not None or len(s) - lo > REGION:
                whole = whole or (s[lo], rep[lo])
                a.append(rep[lo:])
                b.append(np.full(len(s) - lo, whole[1]))
            else:
                tail = (s[lo:], rep[lo:], n[lo:], parts.take(np.arange(lo, len(s))))
            yield out(a, b)
        if tail is not None and len(tail[0]) > 1:
            a, b = [], []
            solve(tail[1], tail[2], tail[3], a, b)
            yield out(a, b)

    return rows.mapInArrow(lambda b: trimmed(link(b)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each vertex of edges (a, b): c is its component's smallest vertex.

    Each round points vertices at their smallest neighbour, follows pointers twice and contracts the edges.
    """
    steps = Steps(edges.sparkSession)
    edges = steps.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = steps.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")))
        for _ in range(2):
            on = to.select(F.col("v").alias("c"), F.col("c").alias("_d"))
            to = to.join(on, "c", "left").select("v", F.coalesce("_d", "c").alias("c"))
        to = steps.put(to)
        rounds.append(to)
        a, b = to.select(F.col("v").alias("a"), F.col("c").alias("ca")), to.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        edges = steps.put(edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    found = rounds[0] if rounds else edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    for later in rounds[1:]:
        found = found.join(later.select(F.col("v").alias("c"), F.col("c").alias("_d")), "c", "left").select("v", F.coalesce("_d", "c").alias("c"))
    found = cut(found)
    steps.drop()
    return found


def linked_components(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Label (smallest index) of each set's component, exactly.

    A pivot is compared with the sets not yet reached that lie in its window: their distances to
    the first pivot differ from its own by at most the radius. Sets of one `known` component are
    reached together and never compared with each other.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat, ends = np.unique(np.concatenate(sets), return_inverse=True)[1], np.r_[0, np.cumsum(n)]
    label, left = np.full(len(sets), -1), np.arange(len(sets))
    mark, radius = np.zeros(int(flat.max()) + 1 if len(flat) else 1, dtype=np.int64), 1 - percent / 100

    def shared(p: int, rows: np.ndarray) -> np.ndarray:
        own = flat[ends[p] : ends[p + 1]]
        mark[own] = 1
        size = n[rows]
        at = np.repeat(ends[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        out = np.add.reduceat(mark[flat[at]], np.r_[0, np.cumsum(size)[:-1]]) if len(rows) else np.zeros(0, dtype=np.int64)
        mark[own] = 0
        return out

    both = shared(0, np.arange(len(sets)))
    first = 1 - both / (n[0] + n - both)
    while len(left):
        root, queue, near = left[0], [], left[:1]
        while len(near):
            reached = np.isin(left, near, assume_unique=True) if known is None else np.isin(known[left], known[near])
            label[left[reached]] = root
            queue += left[reached].tolist()
            left, near = left[~reached], left[:0]
            while queue and len(left) and not len(near):
                p = queue.pop()
                window = np.abs(first[left] - first[p]) <= radius + 1e-9
                window &= 100 * np.minimum(n[left], n[p]) >= percent * np.maximum(n[left], n[p])
                rows = left[window]
                both = shared(p, rows)
                near = rows[100 * both >= percent * (n[rows] + n[p] - both)]
                if len(near):
                    queue.append(p)
    return label


def _solve(groups: DataFrame, key: str, percent: int) -> DataFrame:
    """(a, b): each set's smallest companion in its component, within each group of key.

    Groups (key, rep, set, label) fit a task; sets of one label are known to be in one component.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        sets = [np.asarray(s, dtype=np.int64) for s in group["set"]]
        label = linked_components(sets, percent, group["label"].to_numpy())
        rep = group["rep"].to_numpy()
        keep = label != np.arange(len(rep))
        if sum(map(len, sets)) > LARGE * PARTS:  # of a small group there is little to give back
            trim()
        return pd.DataFrame({"a": rep[label[keep]], "b": rep[keep]})

    return groups.select(key, "rep", "set", "label").groupBy(key).applyInPandas(one, "a long, b long")


def _measured(cells: DataFrame, label: DataFrame) -> DataFrame:
    """(cell, rows, total, rest, core) of cells (cell, rep, n): core is the label of most shingles, rest those of all others."""
    by = cells.join(label, "rep").groupBy("cell", "label").agg(F.sum("n").alias("k"), F.count("*").alias("rows"))
    by = by.groupBy("cell").agg(F.sum("rows").alias("rows"), F.sum("k").alias("total"), F.max(F.struct("k", "rows", "label")).alias("top"))
    return by.select("cell", (F.col("rows") - F.col("top.rows")).alias("rows"), "total", (F.col("total") - F.col("top.k")).alias("rest"), F.col("top.label").alias("core"))


def _place(rows: DataFrame, shell: DataFrame, turn: int, percent: int) -> DataFrame:
    """(cell, pivot, rep, n, linked) of rows (cell, rep, set): to the nearest pivots of its cell.

    Pivots are some sets of shell (cell, rep, set, rows), no more than PIVOT_BYTES of them at
    once; a set goes to all pivots within twice the radius of its nearest, and `linked` says
    whether it links to the pivot. Sets of a cell without pivots have a null pivot.
    """
    chosen = cut(shell.where(F.pmod(F.xxhash64("rep", F.lit(turn)), F.greatest(F.floor(F.col("rows") / PIVOTS), F.lit(1))) == 0).select("cell", "rep", "set"))
    size = chosen.agg(F.coalesce(F.sum(F.size("set").cast("long") * 8), F.lit(0))).first()[0]
    times, out = max(1, -(-size // PIVOT_BYTES)), None
    window = 2 * (1 - percent / 100) + 1e-9
    for i in range(times):  # each time for some of the cells
        mine = F.pmod(F.xxhash64("cell"), F.lit(times)) == i
        pivots: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in chosen.where(mine).orderBy("cell", "rep").collect():
            pivots.setdefault(r["cell"], []).append((r["rep"], np.array(r["set"], dtype=np.int64)))
        shared = rows.sparkSession.sparkContext.broadcast(pivots)

        def place(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for cell, rep, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                    near = shared.value.get(cell, [])
                    both = [len(np.intersect1d(own, p, assume_unique=True)) for _, p in near]
                    d = [1 - x / max(1, len(own) + len(p) - x) for x, (_, p) in zip(both, near, strict=True)]
                    links = [100 * x >= percent * (len(own) + len(p) - x) for x, (_, p) in zip(both, near, strict=True)]
                    out += [(cell, pivot, rep, len(own), k) for (pivot, _), x, k in zip(near, d, links, strict=True) if x <= min(d) + window]
                    out += [] if near else [(cell, None, rep, len(own), False)]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.bool_())], names=["cell", "pivot", "rep", "n", "linked"])

        some = rows.where(mine).select("cell", "rep", "set").mapInArrow(lambda b, place=place: trimmed(place(b)), "cell long, pivot long, rep long, n long, linked boolean")
        out = some if out is None else out.unionByName(some)
    return cut(out)


def _pieces(rows: DataFrame, limit: int) -> DataFrame:
    """(piece, rep, set, label) of rows (cell, rep, set, label, core, total, rest), every piece of about limit shingles.

    Sets of the core need no comparison with each other: where the rest is small, all of it goes
    to every part of the core; else each block of the rest meets each other block.
    """
    in_core = F.col("label") == F.col("core")
    half = limit / 2
    small = F.col("rest") <= half
    parts = F.greatest(F.ceil((F.col("total") - F.col("rest")) / F.greatest(limit - F.col("rest"), F.lit(half))), F.lit(1)).cast("int")
    blocks = F.greatest(F.ceil(F.col("rest") / half), F.lit(1)).cast("int")  # of the rest
    rows = rows.withColumns({"p": parts, "k": blocks, "h": F.xxhash64("rep")})
    every = F.sequence(F.lit(0), F.col("p") - 1)
    own = F.pmod("h", F.col("k")).cast("int")
    core_block = F.col("k") + F.pmod("h", F.col("p")).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.col("k") + F.col("p") - 1), lambda j: j != own)
    as_pair = lambda i, j: F.xxhash64("cell", F.least(i, j), F.greatest(i, j))
    of_small = F.when(in_core, F.array(F.pmod("h", F.col("p")).cast("int"))).otherwise(every)
    of_large = F.when(in_core, F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: as_pair(i, core_block))).otherwise(F.transform(met, lambda j: as_pair(own, j)))
    piece = F.when(small, F.transform(of_small, lambda i: F.xxhash64("cell", i))).otherwise(of_large)
    return rows.select(F.explode(piece).alias("piece"), "rep", "set", "label")


def _sent(ids: DataFrame) -> DataFrame:
    """ids, written, and broadcast if few: so the sets, which are large, stay where they are."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def region_links(sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """(a, b) spanning the links inside the families of sets (fam, rep, set), which are large.

    Each turn, sets of the cells still too large are measured against pivots: those that link to
    a pivot are one component with it, and sets known to be in one component are not compared
    again. Cells that pivots part well become smaller cells, which go through the next turn;
    what is left after TURNS is joined block by block.
    """
    cells = cut(sets.groupBy(F.col("fam").alias("cell"), "rep").agg(F.sum(F.size("set").cast("long")).alias("n")))
    label = _sent(cells.select("rep", F.col("rep").alias("label")).distinct())
    of = sets.select("rep", "set")
    edges = ready = None
    for turn in range(TURNS + 1):
        state = cut(_measured(cells, label).where("rest > 0"))
        good = (F.col("rest") <= limit / 2) if turn < TURNS else F.lit(True)
        now = cut(cells.join(_sent(state.where(good).select("cell")), "cell", "left_semi"))
        ready = now if ready is None else ready.unionByName(now)
        wide = _sent(state.where(~good))
        if turn == TURNS or wide.isEmpty():
            break
        ids = _sent(cells.join(wide, "cell").join(label, "rep"))
        placed = _place(of.join(ids, "rep"), of.join(ids, "rep").where("label <> core"), turn, percent)
        links = placed.where("linked and pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        edges = cut(links.distinct() if edges is None else edges.unionByName(links).distinct())
        known = _sent(components(edges).withColumnsRenamed({"v": "rep", "c": "label"}))
        label = _sent(label.select("rep").join(known, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")))
        cut_up = placed.where("pivot is not null").groupBy("cell", F.xxhash64("cell", "pivot").alias("child"), "rep").agg(F.sum("n").alias("n"))
        spread = cut_up.groupBy("cell", "child").agg(F.sum("n").alias("n")).groupBy("cell").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
        parted = _sent(spread.join(wide, "cell").where((F.col("most") <= PARTED * F.col("total")) & (F.col("all") <= SPREAD * F.col("total"))).select("cell"))
        smaller = cut_up.join(parted, "cell", "left_semi").select(F.col("child").alias("cell"), "rep", "n")
        same = cells.join(wide.select("cell"), "cell", "left_semi").join(parted, "cell", "left_anti")
        cells = cut(same.unionByName(smaller))
    state = _sent(_measured(ready, label).where("rest > 0"))  # with all that is known by now
    rows = of.join(_sent(ready.join(state, "cell").join(label, "rep")), "rep")
    found = _solve(_pieces(rows, limit), "piece", percent)
    return found if edges is None else found.unionByName(edges)


def family_links(docs: DataFrame, families: DataFrame, size: int, percent: int, limit: int = FAMILY, several: DataFrame | None = None) -> DataFrame:
    """(a, b) spanning the links inside families (rep, fam), whose texts are read from docs.

    several: (doc_id, digest, v) of ids with several texts, of which rep v is the one of that digest.
    """
    n = families.count()
    if several is None:
        families = families.select(F.col("rep").alias("doc_id"), "rep", "fam", F.lit(None).cast("string").alias("want"))
    else:
        of = several.select(F.col("v").alias("rep"), "doc_id", F.col("digest").alias("want"))
        families = families.join(of, "rep", "left").select(F.coalesce("doc_id", "rep").alias("doc_id"), "rep", "fam", "want")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(F.broadcast(families) if n <= BROADCAST_IDS else families, "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in _slices(batches):
            found = [shingles(t, size) for t in batch.column(2).to_pylist()]
            found = [s if w is None or w == digest_of(s) else s[:0] for s, w in zip(found, batch.column(3).to_pylist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(found) if found else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["fam", "rep", "set"])

    members = rows.select("fam", "rep", "text", "want").mapInArrow(lambda b: trimmed(make(b)), "fam long, rep long, set array<long>").where(F.size("set") > 0)
    if several is not None:  # rows that repeat both id and text
        members = members.dropDuplicates(["fam", "rep"])
    sizes = cut(members.groupBy("fam").agg(F.sum(F.size("set").cast("long")).alias("total")))
    alone = members.withColumn("label", F.col("rep"))
    large = sizes.where(F.col("total") > limit).select("fam")
    if large.isEmpty():
        return cut(_solve(alone, "fam", percent))
    found = _solve(alone.join(large, "fam", "left_anti"), "fam", percent)
    big = cut(members.join(large, "fam", "left_semi"))
    return cut(found.unionByName(region_links(big, percent, limit)))


def _vertices(found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """found with the vertex v of each row that can link; and (doc_id, digest, v) of ids that several such rows have.

    A vertex is a doc_id, or for those ids one number for each of their sets, below all ids.
    """
    usable = found.where("n > 0 and doc_id is not null")
    again = cut(usable.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    if again.isEmpty():
        return found.withColumn("v", F.col("doc_id")), None
    low = usable.agg(F.min("doc_id")).first()[0]
    few = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    several = cut(usable.join(few, "doc_id").select("doc_id", "digest").distinct())
    several = cut(several.withColumn("v", F.lit(low) - 1 - F.monotonically_increasing_id()))
    return found.join(several, ["doc_id", "digest"], "left").withColumn("v", F.coalesce("v", "doc_id")), several


def _grouped(docs: DataFrame, size: int, percent: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, digest, n, comp) of every row, comp being any vertex of its component; and what _vertices() has of repeated ids."""
    found, several = _vertices(cut(profiles(docs, size, percent)))
    found = found if several is None else cut(found)
    usable = found.where("n > 0 and doc_id is not null")
    multi = cut(usable.groupBy("digest").agg(F.min("v").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"))
    copies = cut(usable.select("v", "digest").join(multi, "digest").where("v > rep").select("v").distinct())
    few = copies.count() <= BROADCAST_IDS
    reps = usable.join(F.broadcast(copies) if few else copies, "v", "left_anti").select(F.col("v").alias("rep"), "n", "first", "parts")
    reps = reps if several is None else reps.dropDuplicates(["rep"])
    smaller = F.floor((F.col("n") * percent + 99) / 100)  # the least size of a partner
    least = F.least(F.lit(SHARED) + F.floor(smaller / SHARED_PER), F.floor((smaller * percent + 99) / 100))
    held = reps.select(F.explode("first").alias("s"), "rep", "n")
    for _ in range(2):  # sets that share too few of their first shingles with others have no link
        often = held.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
        held = cut(held.join(often, "s"))
        enough = held.groupBy("rep", "n").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("rep").distinct()
        held = held.join(enough, "rep")
    regions = held.join(reps.select("rep", "parts"), "rep").select("s", "rep", "n", "parts").repartition("s").sortWithinPartitions("s", "rep")
    families = components(candidate_links(regions, percent)).select(F.col("v").alias("rep"), F.col("c").alias("fam"))
    linked = components(family_links(docs, families, size, percent, limit, several)).select(F.col("v").alias("rep"), F.col("c").alias("comp"))
    out = found.select("doc_id", "n", "digest", "v").join(multi, "digest", "left")
    links = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = out.select("doc_id", "digest", "n", F.when(links, F.coalesce("rep", "v")).alias("rep"))
    return out.join(linked, "rep", "left").select("doc_id", "digest", "n", F.coalesce("comp", "rep").alias("comp")), several


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, limit: int = FAMILY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two texts link when 100 * |x & y| >= percent * |x | y| for their sets of `size`-word
    shingles; component_id is the smallest doc_id reachable by links, itself included. Null
    texts and texts without words have no shingles and link with nothing. Rows that share a
    doc_id link by their own texts only; rows with a null doc_id link with nothing and have a
    null component.
    """
    out, several = _grouped(docs, size, percent, limit)
    if several is None:  # a component's smallest vertex is its smallest id
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    out = cut(out)
    least = out.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return out.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_digest(docs: DataFrame, size: int) -> DataFrame:
    """docs and _near_digest, the digest of each row's set; null for a text without words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t, size) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            digests = pa.array([digest_of(s) if len(s) else None for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, "_near_digest"])

    return docs.mapInArrow(lambda b: trimmed(go(b)), T.StructType([*docs.schema.fields, T.StructField("_near_digest", T.StringType())]))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group of near copies, that of the smallest doc_id; all columns are kept.

    Rows that share a doc_id are judged each by its own text: of a group's rows with the
    smallest id one stays, by the digest of its set. Rows without words stay, but for repeats of
    both doc_id and text. Rows with a null doc_id all stay.
    """
    out, several = _grouped(docs, size, percent, FAMILY)
    if several is None:
        gone = cut(out.where("comp <> doc_id").select("doc_id"))
        kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    else:
        out = cut(out.where("comp is not null"))
        first = out.groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
        gone = cut(out.join(first, "comp").where("doc_id <> first.doc_id or digest <> first.digest").select("doc_id", "digest").distinct())
        ids = cut(several.select("doc_id").distinct())
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        once = docs.join(ids, "doc_id", "left_anti").join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
        more = _with_digest(docs.join(ids, "doc_id", "left_semi").select(*docs.columns), size)
        lost = gone.select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_gone"))
        more = more.join(lost, (more["doc_id"] == lost["_near_id"]) & (more["_near_digest"] == lost["_near_gone"]), "left_anti")
        more = more.where("_near_digest is not null").dropDuplicates(["doc_id", "_near_digest"]).unionByName(more.where("_near_digest is null"))
        kept = once.unionByName(more.select(*docs.columns))
    again = kept.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 and doc_id is not null")
    return kept if again.isEmpty() else kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null"))
