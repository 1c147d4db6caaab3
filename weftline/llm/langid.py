"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of hashed character n-grams (lengths 1 to 4, presence
only) they share, over the root of the product of their numbers. Nystroem landmarks approximate
it; one ridge regression per language is fitted on the landmark features. Scores are linear in
the presence vector, so landmarks and regressions fold into one (hash x language) matrix, and a
batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import cut, fold, let_go

LENGTHS = (1, 2, 3, 4)
HASHES = 1 << 15
#: At most this many labelled rows a language are used to fit, fewer where there are so many languages that all
#: together would exceed SAMPLE; every language has LEAST_A_LANGUAGE of them. Landmarks are bounded alike.
SAMPLE_A_LANGUAGE = 500
SAMPLE = 20_000
LEAST_A_LANGUAGE = 4
LANDMARKS_A_LANGUAGE = 48
LANDMARKS = 2_048
RIDGE = 1e-2
UNKNOWN = "und"
BROADCAST_LANGUAGES = 100_000
BATCH = 64
#: Texts are hashed in pieces of this many code points that overlap; bounds memory, not what is read.
PIECE = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def presence(text: str, out: np.ndarray) -> int:
    """Sets out[h] for each n-gram hash of the text and returns the number set; 0 if it has no letter."""
    letter, found = _is_letter(), False
    for at in range(0, max(1, len(text)), PIECE):
        part = text[max(0, at - max(LENGTHS)) : at + PIECE].lower()
        codes = np.frombuffer((" " + part + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        mask = letter[codes]
        found = found or bool(mask.any())
        codes = np.where(mask, codes, 32)
        if len(codes) > 1:
            codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]  # runs of others are one blank
        codes = codes.astype(np.uint32)
        h = codes
        for n in LENGTHS:
            if n > 1:
                if len(h) < 2:
                    break
                h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            out[mixed >> np.uint32(32 - HASHES.bit_length() + 1)] = 1
    return int(np.count_nonzero(out)) if found else 0


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # hashes x languages

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            x, size = np.zeros((len(part), HASHES), dtype=np.float32), np.zeros(len(part))
            for i, text in enumerate(part):
                size[i] = presence(text, x[i]) if text else 0
            raw = (x @ self.weights) / np.sqrt(np.maximum(size, 1))[:, None]
            for i in np.flatnonzero(size):
                if self.languages:
                    k = int(raw[i].argmax())
                    names[at + i], best[at + i] = self.languages[k], min(1.0, max(0.0, (1 + raw[i, k]) / 2))
        return names, best


def sample(labelled: DataFrame, each: int = SAMPLE_A_LANGUAGE, most: int = SAMPLE) -> list[tuple[str, bytes]]:
    """Up to `each` labelled rows of every language, by the hash of doc_id: (language, packed presence)."""
    known = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("_n")))
    languages = counts.count()
    each = max(LEAST_A_LANGUAGE, min(each, most // max(1, languages)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) * F.col("_n") <= F.lit((2 * each + 20) << 40).cast("double")
    pool = known.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").where(draw)
    pool = pool.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "text")

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = []
            for text in b["text"]:
                x = np.zeros(HASHES, dtype=np.uint8)
                packed.append(np.packbits(x if not presence(text, x) else x).tobytes())
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "doc_id": b["doc_id"], "p": packed})

    small = pool.mapInPandas(shrink, "lang string, h long, doc_id long, p binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "p"))  # a few times `each` rows a language
    rows = small.withColumn("r", first).where(F.col("r") <= each).select("lang", "r", "p").collect()
    return [(x["lang"], bytes(x["p"])) for x in sorted(rows, key=lambda x: (x["lang"], x["r"]))]


def fit(rows: list[tuple[str, bytes]]) -> Model:
    rows = [(lang, p) for lang, p in rows if any(p)]
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros((HASHES, 1), dtype=np.float32))
    own = {lang: [i for i, (x, _) in enumerate(rows) if x == lang] for lang in languages}
    each = max(1, min(LANDMARKS_A_LANGUAGE, LANDMARKS // len(languages)))
    marks = [i for lang in languages for i in own[lang][:each]]

    def unit(i: int) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(rows[i][1], dtype=np.uint8)).astype(np.float32)
        return x / np.sqrt(x.sum())

    landmarks = np.stack([unit(i) for i in marks])
    kernel = np.concatenate([np.stack([unit(i) for i in range(at, min(at + 256, len(rows)))]) @ landmarks.T for at in range(0, len(rows), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    features = kernel @ whiten
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    balance = np.array([1 / len(own[lang]) for lang, _ in rows])[:, None]
    gram = features.T @ (features * balance) + RIDGE * np.eye(features.shape[1])
    w = whiten @ np.linalg.solve(gram, features.T @ (target * balance))
    return Model(languages, (landmarks.T.astype(np.float64) @ w).astype(np.float32))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` with lang_pred and score, which replace columns of those names; null texts and texts without a letter are `und` with score 0."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # HASHES x languages

    def score(texts: pd.Series) -> pd.DataFrame:
        let_go()
        names, best = shared.value.scores([None if pd.isna(t) else t for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": best})

    # not deterministic: else a filter on the result would be pushed below and score every text again
    judged = F.pandas_udf(score, "lang_pred string, score double").asNondeterministic()
    out = docs.select(*keep, judged("text").alias("__weftline_judged"))
    return out.select(*keep, "__weftline_judged.lang_pred", "__weftline_judged.score")


def train(docs: DataFrame, usable: Column) -> Model:
    return fit(sample(docs.where(usable)))


def identify_held_out(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the model learns from rows whose crc32 fold is not `out`.

    One row for each row of docs; repeated rows are judged alike, ties go to the language that
    comes first, and other columns are ignored. Without any labelled row all texts are `und`.
    """
    held = fold("doc_id", folds) == out
    found = identify(docs.select("doc_id", "text"), train(docs, ~held), ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs that have a language, with their columns: `und` goes, and what scores below `least`.

    A score is half of one plus the best language's margin, 1 for its own texts and 0 for others'
    when it was fitted, so it does not depend on the number of languages.
    """
    columns = docs.columns
    rows = docs.withColumnsRenamed({"lang_pred": "__weftline_lang", "score": "__weftline_score"})
    found = identify(rows, train(docs, F.lit(True)))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__weftline_lang": "lang_pred", "__weftline_score": "score"}).select(*columns)
