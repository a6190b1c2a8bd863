"""Bottom-k fingerprints of word shingles (operator 10), in DataFrame functions only.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word
shingles. Sketches of parts merge by the k smallest of their union, and give
estimates of resemblance, containment and the number of distinct shingles.

A text of fewer than five words is one shingle; a text without words (null
included) has the empty sketch, whose resemblance to another empty sketch is 1
and to any other 0. Rows with equal doc_id are ordered by the hash of their
text; equal rows follow each other. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, read_table

K = 64
SHINGLE = 5
#: Ranges of ids at most; each is sorted by one task, which spills.
MOST_RANGES = 16384


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes, ascending. A shingle's hash chains those of its words."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    hashes = F.transform(F.split(bare, SPACES), lambda w: F.xxhash64(w))
    # an array of one element binds the word hashes to a name, so that they are computed once
    whole = F.transform(F.array(hashes), lambda w: _sketch_of(w, k, n))[0]
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(whole)


def _sketch_of(w: Column, k: int, n: int) -> Column:
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + j] for j in range(n)]))
    hashes = F.when(F.size(w) < n, F.array(F.xxhash64(w))).otherwise(shingles)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest that both sketches hold."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k-1) / (k-th smallest as a share of the range)."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: J |A u B| / |A|, at most 1."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def rank_among(cuts: list[int], value: Column, step: int = 128) -> Column:
    """How many of the ascending cuts lie below value (null: 0), looking at every step-th cut and then at one block."""
    if not cuts:
        return F.lit(0)
    listed = lambda xs: F.expr("array(" + ", ".join(f"{x}L" for x in xs) + ")")
    block = F.size(F.filter(listed(cuts[::step]), lambda c: c < value))
    inner = F.size(F.filter(F.slice(listed(cuts), (block - 1) * step + 1, F.lit(step)), lambda c: c < value))
    return F.coalesce(F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inner), F.lit(0))


def with_next(docs: DataFrame, ranges: int = 0) -> DataFrame:
    """docs(doc_id, text, sketch) with next_text and next_sketch in ascending doc_id order, the first after the last.

    Ids are cut into ranges at approximate quantiles (a bounded list), each range
    is sorted by itself, and each range's first row is sent to the range before
    as well. The texts are shuffled once and no task holds more than a range.
    """
    # id and text hash give the order; a null id comes first
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("th"))
    count = docs.select("doc_id").count()
    ranges = ranges or max(1, min(MOST_RANGES, count // 2000))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    rank = rank_among([int(c) for c in cuts], F.col("doc_id"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("th")).withColumn("part", rank)
    firsts = [r for r in ids.groupBy("part").agg(F.min(F.struct("doc_id", "th")).alias("f")).orderBy("part").collect()]
    parts = [r["part"] for r in firsts]
    before = {parts[i]: parts[i - 1] for i in range(len(parts))}  # the first range follows the last
    if not parts:
        own = keyed.select("doc_id", "text", sketch(F.col("text")).alias("sketch"))
        return own.withColumn("next_text", F.col("text")).withColumn("next_sketch", F.col("sketch"))
    lookup = docs.sparkSession.createDataFrame([(r["part"], r["f"]["doc_id"], r["f"]["th"], before[r["part"]]) for r in firsts], "part int, first_id bigint, first_th bigint, prev int")
    # one row per range, MOST_RANGES at most
    rows = keyed.withColumn("part", rank).join(F.broadcast(lookup), "part")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    sent = rows.select(
        "doc_id", "th", "text", sketch(F.col("text")).alias("sketch"),
        F.explode(F.when(is_first, F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("tail")), F.struct(F.col("prev").alias("p"), F.lit(1).alias("tail"))))
                  .otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("tail"))))).alias("to"),
    )
    w = Window.partitionBy("p").orderBy("tail", "doc_id", "th")
    sent = sent.select("doc_id", "th", "text", "sketch", "to.p", "to.tail")
    return sent.select(
        "doc_id", "text", "sketch", "tail", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch")
    ).filter("tail = 0").drop("tail")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    out = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 2) as int))"))
    out = out.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_contained"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))
