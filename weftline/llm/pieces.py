"""SentencePiece encoding by a table of distinct chunks.

No piece of the model runs from another character into a whitespace marker, and none holds a
line feed, so merges never join what a marker or a line feed parts: a text's ids are those of
its marked words in a row. The distinct marked words of all texts are counted, each is
segmented once by the library, and its ids are joined back wherever it stands. The most
frequent words up to a bound of bytes go to every task as sorted hashes; the others are joined
by shuffle, text by text. Words whose hashes collide are joined that way, too.

A model whose pieces do cross markers, or whose library rewrites texts before cutting them, has
whole texts as its chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Steps, kept

MARK = "▁"
#: Bytes of the words that every task holds: 10 a word and 2 or 4 an id.
TABLE_BYTES = 96 << 20
MOST_IDS = 0xFFFF  # of a word in that table
WINDOW = 1 << 20  # bytes looked at together
SHORT = 64  # bytes; longer chunks are hashed one by one
ROWS = 256  # texts at once
#: Up to this many texts' answers are broadcast.
BROADCAST_TEXTS = 2_000
BREAK = re.compile(rb"\n|(?<! ) ")
BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240301)  # fixed: hashes must agree between processes
BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
POWER = np.concatenate([np.ones(1, dtype=np.uint64), np.full(SHORT - 1, BASE)]).cumprod(dtype=np.uint64)


class Model:
    """The library's processor, and whether chunks may be segmented apart."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces]
        crossing = any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        self.apart = plain and not crossing and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and not proto.trainer_spec.treat_whitespace_as_suffix
        self.end = self.processor.eos_id()
        self.lead = len(self.processor.encode("\n"))
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")

    def prepared(self, text: str | None) -> bytes:
        """The bytes that are cut into chunks: markers as spaces, and the first one added as the library does."""
        return b"" if not text else b" " + text.replace(MARK, " ").encode() if self.apart else text.encode()

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk. A line feed before it takes the library's leading marker."""
        if not self.apart:
            return [np.array(x, dtype=self.kind) for x in self.processor.encode(chunks, num_threads=1)]
        return [np.array(x[self.lead :], dtype=self.kind) for x in self.processor.encode(["\n" + c for c in chunks], num_threads=1)]


def model_of(path: str) -> Model:
    """One a process."""
    return kept(path, lambda: Model(path))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(data: bytes, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """Hashes of the chunks of data, which lie side by side, in one or two lanes of 64 bits."""
    b, spans = np.frombuffer(data, dtype=np.uint8), ends - starts
    at = np.minimum(np.arange(len(b)) - np.repeat(starts, spans), SHORT - 1)
    power, long = POWER[at], np.flatnonzero(spans > SHORT)
    digests = [np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), dtype="<u8") for i in long]
    out = []
    for lane in range(lanes):
        h = _mixed(np.add.reduceat(BYTE[lane][b] * power, starts))
        h[long] = [d[lane] for d in digests]
        out.append(h.view(np.int64))
    return out


def cut_up(docs: list[bytes], apart: bool) -> Iterator[tuple[list[int], bytes, np.ndarray, np.ndarray]]:
    """Windows of about WINDOW bytes: (document of each part, bytes, chunk starts, first chunk of each part)."""
    parts: list[tuple[int, bytes]] = []
    size = 0
    for i, data in enumerate(docs):
        at = 0
        while at < len(data):
            found = BREAK.search(data, at + WINDOW) if apart and len(data) - at > WINDOW else None
            to = found.start() if found else len(data)
            parts.append((i, data[at:to]))
            size, at = size + to - at, to
            if size >= WINDOW:
                yield _window(parts, apart)
                parts, size = [], 0
    if parts:
        yield _window(parts, apart)


def _window(parts: list[tuple[int, bytes]], apart: bool) -> tuple[list[int], bytes, np.ndarray, np.ndarray]:
    data = b"".join(p for _, p in parts)
    heads = np.cumsum([0] + [len(p) for _, p in parts[:-1]])
    begins = np.zeros(len(data), dtype=bool)
    if apart:
        b = np.frombuffer(data, dtype=np.uint8)
        space, feed = b == 32, b == 10
        begins = feed | space
        begins[1:] &= feed[1:] | ~space[:-1]
        begins[1:] |= feed[:-1]
    begins[heads] = True
    starts = np.flatnonzero(begins)
    return [i for i, _ in parts], data, starts, np.searchsorted(starts, heads)


def distinct_chunks(docs: DataFrame, path: str) -> DataFrame:
    """(chunk, n) of every distinct chunk of docs (text) and how often it stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                texts = [model.prepared(t) for t in batch.column(0).slice(at, ROWS).to_pylist()]
                for _, data, starts, _ in cut_up(texts, model.apart):
                    ends = np.r_[starts[1:], len(data)]
                    h, other = hashed(data, starts, ends, 2)
                    keys, first, place, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    odd = np.flatnonzero(other != other[first][place])  # another chunk of the same hash
                    n = n - np.bincount(place[odd], minlength=len(keys))
                    rows = np.r_[first, odd]
                    chunks = [data[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(np.r_[n, np.ones(len(odd), dtype=np.int64)])], names=["chunk", "n"])

    return docs.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def segmented(chunks: DataFrame, path: str) -> DataFrame:
    """chunks (chunk, n) with the hash h of each and its ids, as packed bytes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(0).to_pylist()
            data = [t.encode() for t in texts]
            ends = np.cumsum([len(d) for d in data])
            h = hashed(b"".join(data), np.r_[0, ends[:-1]], ends)[0]
            ids = [x.tobytes() for x in model.segment(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h), pa.array(ids, pa.binary())], names=["chunk", "n", "h", "ids"])

    return chunks.mapInArrow(go, "chunk string, n long, h long, ids binary")


class Table:
    """Ids by hash: hashes in order, found by their top bits, and the ids one after another."""

    def __init__(self, parts: list[tuple[bytes, bytes, bytes]], kind: str):
        """parts: hashes (ascending over all), numbers of ids, and ids, as packed bytes."""
        whole = lambda i, t: np.concatenate([np.frombuffer(p[i], dtype=t) for p in parts] or [np.zeros(0, dtype=t)])
        self.hashes, self.sizes, self.ids = whole(0, "<i8"), whole(1, "<u2"), whole(2, kind)
        self.begins = np.zeros(len(self.sizes), dtype=np.uint32)
        np.cumsum(self.sizes[:-1], dtype=np.uint32, out=self.begins[1:])
        self.shift = np.uint64(64 - max(1, len(self.hashes).bit_length() - 1))
        counts = np.bincount(self._top(self.hashes), minlength=1 << (64 - int(self.shift)))
        self.first = np.zeros(len(counts) + 1, dtype=np.int32)
        np.cumsum(counts, dtype=np.int32, out=self.first[1:])

    def _top(self, h: np.ndarray) -> np.ndarray:
        return ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        top = self._top(h)
        at, to = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, dtype=np.int64)
        rows = np.flatnonzero(at < to)
        while len(rows):
            same = self.hashes[at[rows]] == h[rows]
            out[rows[same]] = at[rows[same]]
            rows = rows[~same]
            at[rows] += 1
            rows = rows[at[rows] < to[rows]]
        return out


class Packed:
    """A Table in the driver, which never unpacks it; a task that reads it from a broadcast gets the Table."""

    def __init__(self, parts: list[tuple[bytes, bytes, bytes]], kind: str):
        self.parts, self.kind = parts, kind

    def __reduce__(self):
        return Table, (self.parts, self.kind)


def _common(words: DataFrame, kind: np.dtype) -> Packed:
    """The rows (h, ids), of checked size, sorted and packed by tasks and fetched a partition at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_pylist()
            cols = [b.column(0).to_numpy().tobytes(), np.array([len(x) // kind.itemsize for x in ids], dtype="<u2").tobytes(), b"".join(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["h", "sizes", "ids"])

    rows = words.select("h", "ids").repartitionByRange(8, "h").sortWithinPartitions("h").mapInArrow(pack, "h binary, sizes binary, ids binary")
    return Packed([(bytes(r["h"]), bytes(r["sizes"]), bytes(r["ids"])) for r in rows.toLocalIterator()], kind.str)


def _lookups(batch: pa.RecordBatch, column: int, model: Model, table: Table) -> Iterator[tuple[int, list, Iterator]]:
    """By ROWS texts: their first row, and the windows as (documents, bytes, starts, ends, heads, places)."""
    for at in range(0, batch.num_rows, ROWS):
        texts = batch.column(column).slice(at, ROWS).to_pylist()

        def windows(texts=texts):
            for docs, data, starts, heads in cut_up([model.prepared(t) for t in texts], model.apart):
                ends = np.r_[starts[1:], len(data)]
                yield docs, data, starts, ends, heads, table.find(hashed(data, starts, ends)[0])

        yield at, texts, windows()


def encode(docs: DataFrame, path: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, ids, decoded of every row of docs (doc_id, text): the library's ids with the end id, and what it decodes them to.

    Null texts are empty and have the end id alone. Rows that repeat a doc_id or a text are
    encoded each; other columns are ignored. An empty table has no rows.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind, steps = Model(path).kind, Steps(spark)
    words = steps.put(segmented(distinct_chunks(rows, path), path))
    weight = 10 + F.octet_length("ids").cast("long")
    level = F.floor(F.log2("n")).cast("int")
    by_level = sorted(words.groupBy(level.alias("k")).agg(F.sum(weight).alias("w")).collect(), key=lambda r: -r["k"])  # 63 rows at most
    least, room = 1 << 62, table_bytes
    for r in by_level:
        room -= r["w"]
        if room < 0:
            break
        least = 1 << r["k"]
    clash = steps.put(words.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h", F.lit(True).alias("clash")))
    clashes = clash.count()
    mark = words.join(F.broadcast(clash) if clashes <= 1_000_000 else clash, "h", "left") if clashes else words.withColumn("clash", F.lit(None).cast("boolean"))
    common = F.col("clash").isNull() & (F.col("n") >= least) & (F.octet_length("ids") <= MOST_IDS * kind.itemsize)
    table = spark.sparkContext.broadcast(_common(mark.where(common), kind))
    if not clashes and room >= 0 and mark.where(~common).isEmpty():
        return _encoded(rows.withColumn("own", F.lit(None).cast("array<struct<chunk:string,ids:binary>>")), path, table, id_type)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for _, texts, windows in _lookups(batch, 0, model, table.value):
                for docs_of, data, starts, ends, heads, places in windows:
                    lost = np.flatnonzero(places < 0)
                    of = np.searchsorted(heads, lost, side="right") - 1
                    keys = [int(hashlib.sha256(texts[d].encode()).hexdigest()[:15], 16) for d in docs_of]
                    chunks = [data[starts[i] : ends[i]].decode() for i in lost]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in of], pa.int64()), pa.array(chunks, pa.string())], names=["key", "chunk"])

    # texts that share a key share their answers, of which each takes its own
    asked = rows.select("text").mapInArrow(ask, "key long, chunk string").distinct()
    answers = asked.join(mark.where(~common).select("chunk", "ids"), "chunk").groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("own"))
    answers = steps.put(answers)
    answers = F.broadcast(answers) if answers.count() <= BROADCAST_TEXTS else answers
    return _encoded(rows.withColumn("key", F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")).join(answers, "key", "left").select("doc_id", "text", "own"), path, table, id_type)


def _encoded(rows: DataFrame, path: str, table, id_type: str) -> DataFrame:
    """rows (doc_id, text, own), own being the chunks that the table does not hold, as doc_id, ids and decoded."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        end = np.array([model.end], dtype=np.int32)
        for batch in batches:
            for at, texts, windows in _lookups(batch, 1, model, table.value):
                found: list[list[np.ndarray]] = [[] for _ in texts]
                own = batch.column(2).slice(at, ROWS)
                for docs_of, data, starts, ends, heads, places in windows:
                    ids, to = _joined_back(data, starts, ends, places, table.value, own, docs_of, heads, model.kind)
                    for k, d in enumerate(docs_of):
                        found[d].append(ids[to[heads[k]] : to[heads[k + 1]] if k + 1 < len(heads) else len(ids)])
                each = [np.concatenate([*x, end]) for x in found]
                decoded = model.processor.decode([x.tolist() for x in each])
                lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in each]).astype(np.int32), np.concatenate(each))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, ROWS), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(go, f"doc_id {id_type}, ids array<int>, decoded string")


def _joined_back(data, starts, ends, places, table: Table, own: pa.ListArray, docs_of: list[int], heads, kind) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a window's chunks in their order, and where each chunk's begin."""
    lost = np.flatnonzero(places < 0)
    answers: dict[int, np.ndarray] = {}
    known: dict[int, dict[str, bytes]] = {}
    for i, of in zip(lost.tolist(), (np.searchsorted(heads, lost, side="right") - 1).tolist(), strict=True):
        d = docs_of[of]
        if d not in known:
            known[d] = {x["chunk"]: x["ids"] for x in own[d].as_py()}
        answers[i] = np.frombuffer(known[d][data[starts[i] : ends[i]].decode()], dtype=kind)
    sizes = np.where(places >= 0, table.sizes[places] if len(table.sizes) else 0, 0).astype(np.int64)
    for i, ids in answers.items():
        sizes[i] = len(ids)
    to = np.r_[0, np.cumsum(sizes)][:-1]
    out = np.empty(int(sizes.sum()), dtype=np.int32)
    here = np.flatnonzero(places >= 0)
    if len(here):
        n = sizes[here]
        shift = np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
        step = np.arange(len(shift)) - shift
        out[np.repeat(to[here], n) + step] = table.ids[np.repeat(table.begins[places[here]].astype(np.int64), n) + step]
    for i, ids in answers.items():
        out[to[i] : to[i] + len(ids)] = ids
    return out, to


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 of encode()'s rows."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
