"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

A window is 13 consecutive words of a benchmark item; a shorter item is one window. Any
occurrence of a window of L words in a text covers one block of c = (L + 1) // 2 words that
starts at a multiple of c, so only those blocks are hashed and looked up in the broadcast set
of the benchmark's c-grams. Each block found is verified: the windows around it are compared
word by word. Texts are scanned in one narrow stage; only verified hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import cut

WINDOW = 13
RATIO = 20  # a text is contaminated if RATIO * hit words >= words
#: Up to this many benchmark grams (8 bytes each) are broadcast; beyond, Spark joins them by shuffle.
BROADCAST_GRAMS = 2_000_000
#: Up to this many windows (about 100 bytes each) are broadcast.
BROADCAST_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII but letters and digits, one by one: Java tests such a class with one table look-up.
APART = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{APART}]+"


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def _gram(words: str, start: Column, size: int) -> Column:
    """Hash of `size` words from `start`, in lower case: equal windows have equal hashes."""
    return F.xxhash64(F.lit(size), *[F.lower(F.get(F.col(words), start + i)) for i in range(size)])


def _exact(words: str, start: Column, size: Column) -> Column:
    """The window's words with A-Z lower-cased, joined by blanks."""
    return F.translate(F.array_join(F.slice(F.col(words), start + 1, size), " "), UPPER, LOWER)


def _starts(last: Column, step: int = 1) -> Column:
    """0, step, 2 step ... up to last; none if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))


def find_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _th, pos, len, item_id): every occurrence of a window; _th is the text's hash."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = items.withColumn("len", F.least("n", F.lit(window))).withColumn("c", F.expr("(len + 1) div 2"))
    windows = items.select("item_id", "len", F.explode(_starts(F.col("n") - F.col("len"))).alias("s"), "w")
    windows = cut(windows.select("item_id", "len", _exact("w", F.col("s"), F.col("len")).alias("win")).distinct())
    shapes = items.groupBy("len", "c").agg(F.sum("n").alias("grams")).collect()  # at most `window` rows
    small = sum(r["grams"] for r in shapes) <= BROADCAST_GRAMS
    few = windows.count() <= BROADCAST_WINDOWS
    # explode(array(x)) keeps Spark from pushing filters on the words below, where it would split the text again for each
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), F.explode(F.array(words_of("text"))).alias("w")).withColumn("n", F.size("w"))
    found = None
    for r in shapes:
        size, c = r["len"], r["c"]
        grams = items.where(F.col("len") == size).select("w", F.explode(_starts(F.col("n") - c)).alias("s"))
        grams = grams.select(_gram("w", F.col("s"), c).alias("g")).distinct()
        blocks = base.where(F.col("n") >= size).select("*", F.explode(_starts(F.col("n") - c, c)).alias("p"))
        blocks = blocks.withColumn("g", _gram("w", F.col("p"), c))
        if small:
            blocks = blocks.join(F.broadcast(grams), "g", "left_semi")
        else:  # the words stay where they are until it is known which texts have a hit
            found_at = cut(blocks.select("doc_id", "_th", "p", "g").join(grams, "g", "left_semi").groupBy("doc_id", "_th").agg(F.collect_set("p").alias("ps")))
            found_at = found_at.select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "ps")
            blocks = base.join(found_at, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))).withColumn("p", F.explode("ps"))
        around = F.sequence(F.greatest(F.col("p") - (size - c), F.lit(0)), F.least(F.col("p"), F.col("n") - size))
        spans = blocks.select("doc_id", "_th", "w", F.explode(F.when(F.col("p") - (size - c) <= F.col("n") - size, around)).alias("pos"))
        spans = spans.select("doc_id", "_th", "pos", F.lit(size).alias("len"), _exact("w", F.col("pos"), F.lit(size)).alias("win"))
        of_size = windows.where(F.col("len") == size).select("win", "item_id")
        hits = spans.join(F.broadcast(of_size) if few else of_size, "win").drop("win")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("_th"), F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit("").alias("item_id")).where("false")
    return found.distinct()


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and _th).

    Null text has no words and is clean; null or empty items have no windows. Rows repeated
    with the same doc_id and text each get the same result; other columns are ignored.
    """
    hits = cut(find_hits(docs, bench, window))
    key = ["doc_id", "_th"]
    by_pos = hits.groupBy(*key, "pos").agg(F.max("len").alias("len"))
    order = Window.partitionBy(*key).orderBy("pos")
    before = F.max(F.col("pos") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("pos") + F.col("len") - F.greatest(F.col("pos"), F.coalesce(before, F.lit(0)))
    covered = by_pos.select(*key, F.greatest(new, F.lit(0)).alias("new")).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    ids = hits.select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    ids = ids.select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "ids")
    found = covered.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))).select("_d", "_t", "n_hit", "ids")
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["_d"]) & (base["_th"] == found["_t"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.greatest(F.size(F.coalesce("ids", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * ratio >= F.col("n_words"))).alias("contaminated"), "_th",
    )


#: Columns that exist only inside the functions below, which keep all of docs' own.
D, T, K, H = ("__weftline_" + x for x in ("d", "t", "k", "h"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = contamination(docs, bench, window, ratio).where("contaminated").select(F.col("doc_id").alias(D), F.col("_th").alias(T)).distinct()
    keyed = docs.withColumn(K, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(D)) & (F.col(K) == F.col(T)), "left_anti").drop(K)


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every hit word, and what separates it from the word before, cut out of text."""
    hits = find_hits(docs, bench, window).select("doc_id", "_th", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("p")).distinct()
    hits = hits.groupBy("doc_id", "_th").agg(F.map_from_arrays(F.sort_array(F.collect_list("p")), F.array_repeat(F.lit(True), F.count("*").cast("int"))).alias(H))
    hits = hits.select(F.col("doc_id").alias(D), F.col("_th").alias(T), H)
    keyed = docs.withColumn(K, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col(D)) & (F.col(K) == F.col(T)), "left")
    gap = f"[{APART}]*"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(gap + WORD), F.lit(0))
    tail = F.regexp_extract(F.col("text"), gap + r"\z", 0)
    cleaned = F.concat(F.array_join(F.filter(pieces, lambda _, i: ~F.coalesce(F.try_element_at(H, i), F.lit(False))), ""), tail)
    return out.withColumn("text", F.when(F.col(H).isNull(), F.col("text")).otherwise(cleaned)).drop(K, D, T, H)
