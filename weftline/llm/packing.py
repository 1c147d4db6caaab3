"""Best-fit packing of documents into sequences by sums of squares.

Each piece goes where the sum, over residual gaps, of the squared numbers of open bins becomes
smallest; a new bin is one of the choices. Only lengths matter, so texts are tokenised where
they lie, and rows of a few numbers a piece are dealt to blocks of bounded size and packed
there, longest pieces first. Bins that a block leaves under-filled are packed again together,
as if each were one piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, kept, trimmed

CAPACITY = 4096
END = 1  # closes every document
#: Pieces packed in one block; bounds a task's rows.
BLOCK = 65_536
#: Bins filled to less than this share are packed again with those of other blocks.
FULL = 0.995
CACHED_WORDS = 300_000
TEXTS = 64  # whose new words are looked up together
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LAST = END.to_bytes(4, "little")
#: Elsewhere Python's lower case is the vocabulary's.
WIDE = re.compile("[\u0130\u0250-\U0010ffff]")
#: White space to Python, but not to the vocabulary.
CONTROL = re.compile("[\x1c-\x1f]")
AFTER_MARK = re.compile(r"[.,](?<=[\W_].)\s")
TOKENIZER = "word_bpe_49k.json"
#: White space as Unicode defines it, fixed values.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class WordTokenizer:
    """Token ids of whole texts, remembered by white-space-delimited word as packed bytes.

    The vocabulary's pre-tokeniser drops white space and never joins across it, so a text's ids
    are its words' ids in a row. Texts that spell a special token are encoded whole. Two
    generations of words are kept; a word not met in the last one is forgotten.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.known, self.old = Tokenizer.from_file(path), cached, {"": b""}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not WIDE.search(text):
            text = text.lower()  # as the vocabulary's normaliser does; there the two agree
        if CONTROL.search(text):
            return SPACE.split(text)
        if not AFTER_MARK.search(text):  # a mark after a letter or digit is a word to the pre-tokeniser
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return text.split()

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, END last."""
        split = [None if "<|" in t else self._words(t) for t in texts]
        new = set().union(*[w for w in split if w is not None]).difference(self.known)
        if len(self.known) > self.cached:
            self.old, self.known = self.known, {"": b""}
            new = set().union(*[w for w in split if w is not None]).difference(self.known)
        self._learn(new)
        find = self.known.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], dtype="<u4")
            else:
                yield np.frombuffer(b"".join(map(find, words)) + LAST, dtype="<u4")

    def _learn(self, new: set[str]) -> None:
        """Puts words into the cache; marks that end a word of letters are looked up apart."""
        known, old, ends, letters, rest = self.known, self.old, [], set(), set()
        for w in new:
            if (data := old.get(w)) is not None:
                known[w] = data
            elif w.isalpha():
                letters.add(w)
            elif (stem := w.rstrip(MARKS)).isalpha():
                ends.append((w, stem, w[len(stem) :]))
                letters.add(stem)
                rest.add(w[len(stem) :])
            else:
                rest.add(w)
        letters, rest = list(letters.difference(known)), list(rest.difference(known))
        if letters:  # each is one word to the pre-tokeniser, so the ids that end words part them
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts, data = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), ids.tobytes()
            if len(cuts) == len(letters):
                known.update(zip(letters, (data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                rest += letters
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, stem, mark in ends:
            known[w] = known[stem] + known[mark]


def tokenizer_of(path: str) -> WordTokenizer:
    """One a process, so that later tasks find the words of earlier ones."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(path, lambda: WordTokenizer(path))


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces. Null text is empty and has one token."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            rows = []
            texts = batch["text"].tolist()
            groups = (texts[i : i + TEXTS] for i in range(0, len(texts), TEXTS))
            for doc_id, ids in zip(batch["doc_id"], (x for g in groups for x in tokenizer.ids(g)), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(lambda b: trimmed(cut_up(b)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity), longest placed first, equal ones in their order.

    Ties of the sum go to the smallest gap that is left, a new bin last.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = 0
    for i in np.argsort(-np.asarray(lengths), kind="stable"):
        size = int(lengths[i])
        now, after = count[size:], count[: capacity + 1 - size]
        change = 2 - 2 * now + 2 * after
        change[0] = 1 - 2 * now[0]  # a bin that is full no longer counts
        change[now == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        if change[best] > 2 * count[capacity - size] * (size < capacity) + (size < capacity):
            gap, b, used = capacity, used, used + 1
        else:
            gap = best + size
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def _dealt(pieces: DataFrame, blocks: int) -> DataFrame:
    """pieces, which are written, with _block: their rows counted through and dealt in turn, so that blocks differ by one row at most."""
    number = F.monotonically_increasing_id()
    rows = pieces.select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    counts, before, at = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect(), [], 0  # a row a partition
    for r in counts:
        before.append((r["_part"], at))
        at += r["n"]
    begins = pieces.sparkSession.createDataFrame(before, "_part long, _at long")
    return rows.join(F.broadcast(begins), "_part").withColumn("_block", F.pmod(F.col("_at") + F.col("_i"), F.lit(blocks)).cast("int")).drop("_part", "_at", "_i")


def _pack_blocks(pieces: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """pieces (length, ...), which are written, with bin (block, number in it) and offset."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = pack(block["length"].to_numpy(), capacity)
        return block.assign(bin=bins, offset=offsets)

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", _block int, bin long, offset long"
    return _dealt(pieces, blocks).groupBy("_block").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Every piece with its sequence_id and offset; see pieces_of for the pieces.

    Repeated doc_ids are packed as documents of their own, an empty table has no sequences, and
    columns other than doc_id and text are ignored.
    """
    pieces = cut(pieces_of(docs, path, capacity))
    blocks = max(1, -(-pieces.count() // block))
    packed = _pack_blocks(pieces, blocks, capacity)
    if blocks > 1:
        packed = cut(packed)
        fill = packed.groupBy("_block", "bin").agg(F.sum("length").alias("length"))
        loose = fill.where(F.col("length") < int(capacity * FULL)).select(F.col("_block").cast("long").alias("doc_id"), F.col("bin").cast("int").alias("piece"), F.lit(0).cast("long").alias("start"), "length")
        loose = cut(loose)
        again = _pack_blocks(loose, max(1, -(-loose.count() // block)), capacity)
        moved = again.select(F.col("doc_id").cast("int").alias("_block"), F.col("piece").cast("long").alias("bin"), (F.col("_block").cast("long") + F.lit(1 << 20)).alias("_nb"), F.col("bin").alias("_n"), F.col("offset").alias("_o"))
        packed = packed.join(moved, ["_block", "bin"], "left")
        packed = packed.withColumn("offset", F.col("offset") + F.coalesce("_o", F.lit(0).cast("long")))
        number = F.shiftleft(F.coalesce("_nb", F.col("_block").cast("long")), 32) + F.coalesce("_n", "bin")
    else:
        number = F.shiftleft(F.col("_block").cast("long"), 32) + F.col("bin")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")


def pack_table(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(tokenizer))
