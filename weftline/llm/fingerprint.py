"""SimHash fingerprints of documents, and all pairs of fingerprints within a Hamming radius.

Terms are runs of five words (all words of a shorter text), each weighing as often as it
occurs. Its 64-bit hash votes for the bits it has set and against the others. The votes are
summed two bits to a long, 32 bits each, in one hash aggregation over the exploded terms.
Near fingerprints are found in permuted block tables: of r + l blocks of the bits, two
fingerprints at distance r or less share at least l unchanged, so each table brings another
choice of l blocks to the front and looks fingerprints up by them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import cut

WORDS = 5
BITS = 64
RADIUS = 3
#: Tables of near_fingerprints: as many leading blocks (3 at most) are matched as this many tables allow.
TABLES = 24
#: Classes up to this many (16 bytes each) are broadcast.
BROADCAST_CLASSES = 500_000
#: Ranges of doc_id in which "the next document" is looked up, at most; each is sorted in one task, which spills.
RANGES = 65_536
GROUP = 256  # bounds of ranges are searched in two steps
ROWS_A_RANGE = 4096


def _votes(words: str, key: list[str], keep: list[str], df: DataFrame, size: int) -> DataFrame:
    """key, keep and `fp` (bigint) for each row of df, which holds its words; key is unique.

    All of keep must be of fixed width: strings in it would turn the hash aggregation into a sort.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    terms = df.select(*key, *keep, words, F.explode(starts).alias("_i"))
    terms = terms.select(*key, *keep, F.xxhash64(*[F.get(F.col(words), F.col("_i") + j) for j in range(size)]).alias("_h"))
    pair = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftright("_h", k).bitwiseAND(pair)).alias(f"_s{k}") for k in range(32)]
    counted = terms.groupBy(*key).agg(F.count("*").alias("_n"), *sums, *[F.first(c).alias(c) for c in keep])
    half = F.lit(0xFFFFFFFF)
    bits = []
    for k in range(BITS):
        votes = F.shiftrightunsigned(F.col(f"_s{k % 32}"), 32 * (k // 32)).bitwiseAND(half)
        bits.append(F.when(votes * 2 > F.col("_n"), F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0).cast("long")))
    return counted.select(*key, *keep, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """1 minus the share of bits that differ."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(id, fp, fingerprint) of each row. Null text is empty; all texts without words share one value.

    Rows that repeat both id and text are one row of the result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("_id", F.xxhash64("_t").alias("_th"), words_of(F.col("_t")).alias("_w")).withColumn("_k", F.xxhash64("_w"))
    out = _votes("_w", ["_id", "_th"], ["_k"], rows.dropDuplicates(["_id", "_th"]), size)
    return out.select(F.col("_id").alias(id_col), "fp", hex_of("fp").alias("fingerprint"))


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each row's class (its fingerprint), and all pairs of different fingerprints within the radius.

    Classes carry any number of equal fingerprints, so copies never multiply pairs. A table keys
    a fingerprint by one choice of `lead` of its blocks; a pair is reported only from the first
    table in which its two fingerprints meet. Null fingerprints are in no pair.
    """
    if not 0 <= radius < BITS:
        raise ValueError("the radius must be from 0 to 63")
    members = fps.select(id_col, "fp")
    classes = members.select("fp").where("fp is not null").distinct()
    lead = max([n for n in (1, 2, 3) if radius + n <= BITS and comb(radius + n, n) <= TABLES], default=1)
    blocks = radius + lead
    edge = [round(BITS * b / blocks) for b in range(blocks + 1)]
    masks = [sum((1 << edge[b + 1]) - (1 << edge[b]) for b in chosen) for chosen in combinations(range(blocks), lead)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]  # as signed longs
    at = F.array(*[F.lit(m).cast("long") for m in masks])
    tables = classes.select("fp", F.posexplode(at).alias("t", "m")).select("t", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    a, c = tables.withColumnRenamed("fp", "fp_a"), tables.withColumnRenamed("fp", "fp_b")
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    pairs = a.join(c, ["t", "key"]).where("fp_a < fp_b").withColumn("distance", F.bit_count(differ)).where(F.col("distance") <= radius)
    first = F.array_position(F.transform(at, lambda m: differ.bitwiseAND(m) == 0), True) - 1
    return members, pairs.where(first == F.col("t")).select("fp_a", "fp_b", "distance")


def near_counts(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near): of each fingerprint of fps (fp) that has any, the number of other fingerprints within the radius."""
    pairs = near_fingerprints(fps.select(F.lit(0).alias("doc_id"), "fp"), radius)[1]
    ends = pairs.select(F.explode(F.array("fp_a", "fp_b")).alias("fp"))
    return ends.groupBy("fp").agg(F.count("*").alias("n_near"))


def _numbers(values: list[int], kind: str) -> Column:
    """An array literal; built from one string, as a literal a value would make the plan huge."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, (range, rn), next text and (next_range, next_rn), by descending doc_id, then text.

    Ranges of doc_id are sorted apart; the first row of every range is also sent, as a ghost, to
    the end of the range before it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    least, most, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, min(RANGES, n // ROWS_A_RANGE)) if least is not None and most > least else 1
    bounds = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        found = rows.select(F.percentile_approx("doc_id", cuts, max(50_000, 4 * ranges))).first()[0]
        bounds = sorted(set(found), reverse=True)
    place = F.lit(0)
    if bounds:
        below = lambda b: F.col("doc_id") < b
        group = F.size(F.filter(_numbers(bounds[::GROUP], "long"), below))
        inside = F.size(F.filter(F.slice(_numbers(bounds, "long"), F.greatest(group - 1, F.lit(0)) * GROUP + 1, F.lit(GROUP)), below))
        place = F.when(group > 0, (group - 1) * GROUP + inside).otherwise(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(place).cast("int"))
    heads = cut(rows.groupBy("range").agg(F.max("doc_id").alias("_head")))  # RANGES rows at most
    used = sorted(r["range"] for r in heads.select("range").collect())
    prior = {r: used[i - 1] for i, r in enumerate(used)}  # the first range's head follows the last range
    after = {p: r for r, p in prior.items()}
    home, follow = (F.get(_numbers([of.get(r, -1) for r in range(max(used, default=0) + 1)], "int"), F.col("range")) for of in (prior, after))
    ghosts = rows.join(F.broadcast(heads.withColumnRenamed("range", "_r")), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("range") == F.col("_r")), "left_semi")
    ghosts = ghosts.select("doc_id", "text", home.alias("range"), F.lit(True).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("doc_id", "text", "range", "ghost"))
    order = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    both = both.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"), F.lead("ghost").over(order).alias("_g"))
    both = both.where(~F.col("ghost"))
    return both.select("doc_id", "text", "range", "rn", "next_text", F.when(F.col("_g"), follow).otherwise(F.col("range")).alias("next_range"), F.when(F.col("_g"), 1).otherwise(F.col("rn") + 1).alias("next_rn"))


def _longs(sha: str) -> list[Column]:
    """The 64 hexadecimal digits of a column as four longs."""
    return [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"{sha}{i}") for i in range(4)]


def compare_edited(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited and the next text.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the
    next document (descending doc_id, rows of one doc_id by text; null ids last; the first
    follows the last, so a lone row follows itself). Null text is empty; rows that repeat are
    rows of their own, and columns other than doc_id and text are ignored. n_near is the number
    of other fingerprints among all texts' within the radius.
    """
    rows = _with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    place = ["range", "rn", "doc_id", "n_chars", "next_range", "next_rn"]
    two = rows.select(*place, F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.posexplode(F.array("text", "edited")).alias("kind", "t"))
    two = two.select(*place, "kind", *_longs("sha"), words_of(F.col("t")).alias("w"))
    keep = [*place[2:], *(f"sha{i}" for i in range(4))]
    voted = _votes("w", ["range", "rn", "kind"], keep, two, size)
    voted = voted.groupBy("range", "rn").agg(*[F.first(c).alias(c) for c in keep], F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    voted = cut(voted)
    after = voted.select(F.col("range").alias("next_range"), F.col("rn").alias("next_rn"), F.col("fp").alias("nfp"))
    near = cut(near_counts(voted, radius))
    out = voted.join(after, ["next_range", "next_rn"]).join(F.broadcast(near) if near.count() <= BROADCAST_CLASSES else near, "fp", "left")
    sha = F.concat(*[hex_of(f"sha{i}") for i in range(4)])
    return out.select("doc_id", "n_chars", sha.alias("edited_sha256"), hex_of("fp").alias("fingerprint"), hex_of("efp").alias("edited_fingerprint"), likeness("fp", "efp").alias("near_edited"), likeness("fp", "nfp").alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
