"""Mixing sources to target weights by the cube method (operator 6).

Each source has a target number of words; its ratio target / size, at most 3,
says how often a document is taken: floor(ratio) times surely and once more
with the fractional rest as inclusion probability. The cube method settles
these probabilities: they move through the null space of the balancing
constraints (documents and words) until one reaches 0 or 1, again and again.

The flight runs in blocks of one source's documents, holding only three
undecided documents at a time, large ones first; at most two stay undecided in
a block. Those of all blocks meet in fewer blocks, and so on; two and some
smaller ones of the last block are the landing problem, settled by the choice
nearest the source's words. Blocks are dealt by a hash of the document, so a hot source is many
blocks. Random choices come from document hashes, so reruns agree.

Null text has size 0, null source is a source (last in order). Sources without
words have target 0. Rows with equal doc_id are separate documents, told apart
by their text and then by a number. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

WEIGHTS = (1, 2, 3)
MOST = 3
#: Undecided documents per block, about.
BLOCK = 4_000
#: Documents of a source, below its median size, that are left to the landing.
LANDING = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, ratio), one row per source.

    The total is shared by weight; what exceeds `most` times a source's size is
    shared again among the others until none is above. Sums over sources alone
    come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, not per document: the order needs one window.
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = materialise(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words per unit of weight; a source is capped if weight * level is above its cap
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level > most * F.col("source_size")
        fixed, free = per.agg(F.sum(F.when(capped, most * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free:
            break
        new = (total - (fixed or 0)) / free
        if level is not None and new <= level:
            break
        level = new
    cap = (most * F.col("source_size")).cast("double")
    target = F.least(cap, F.col("weight") * F.lit(float(level or 0.0)))
    return per.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("ratio"))


def flight(units: Iterator[tuple], eps: float = 1e-9) -> Iterator[tuple]:
    """units: (key, size, probability, coin in [0, 1)). Yields (key, size, probability), decided (0.0 or 1.0) or not.

    Three units are undecided at a time; u spans the null space of the two
    constraints (sum of p, sum of p * size) over them.
    """
    held: list[list] = []
    for key, size, p, coin in units:
        if p <= eps or p >= 1 - eps:
            yield key, size, float(p >= 0.5)
            continue
        held.append([key, size, p])
        while len(held) == 3:
            (_, a, pa_), (_, b, pb), (_, c, pc) = held
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
            p = (pa_, pb, pc)
            up = min((1 - x) / v if v > 0 else -x / v for x, v in zip(p, u, strict=True) if v)
            down = min(x / v if v > 0 else (x - 1) / v for x, v in zip(p, u, strict=True) if v)
            step = up if coin * (up + down) < down else -down
            coin = (coin * 7919.137 + 0.31) % 1.0
            keep = []
            for h, v in zip(held, u, strict=True):
                h[2] += step * v
                if h[2] <= eps or h[2] >= 1 - eps:
                    yield h[0], h[1], float(h[2] >= 0.5)
                else:
                    keep.append(h)
            held = keep
    for h in held:
        yield tuple(h)


def land(units: list[tuple]) -> dict:
    """The last undecided units of a source, LANDING + 2 at most, to 0 or 1.

    Largest first, each takes the value that keeps the words taken so far nearest
    those expected, so small documents make up for a large one; the last twelve
    take the best of all choices.
    """
    units = sorted(units, key=lambda u: -u[1])
    head, tail = units[:-12], units[-12:]
    off, out = 0.0, {}  # words taken less words expected
    for key, size, p in head:
        take = abs(off + (1 - p) * size) <= abs(off - p * size)
        off += (take - p) * size
        out[key] = float(take)
    n = len(tail)
    choices = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    size, p = np.array([u[1] for u in tail], float), np.array([u[2] for u in tail])
    far = np.abs(off + choices @ size - size @ p) + 1e-6 * np.abs(choices.sum(1) - p.sum())
    return out | {u[0]: float(x) for u, x in zip(tail, choices[int(np.argmin(far))], strict=True)}


OUT = pa.schema([("uid", pa.int64()), ("grp", pa.int64()), ("size", pa.int64()), ("p", pa.float64()), ("h", pa.int64())])


def _blocks(last: bool):
    """Rows come sorted by group; each group is flown by itself, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def groups():
            it, row = rows(), None
            row = next(it, None)
            while row is not None:
                block = row[0]

                def own():
                    nonlocal row
                    while row is not None and row[0] == block:
                        _, uid, grp, size, p, h = row
                        yield (uid, grp, h), size, p, (h % 1000003) / 1000003
                        row = next(it, None)

                yield own()

        for group in groups():
            rest, kept = [], []
            if last:  # BLOCK rows, about
                units = list(group)
                spared = set(np.linspace(len(units) // 2, len(units) - 1, min(LANDING, len(units) - len(units) // 2), dtype=int).tolist())
                kept, group = [units[i] for i in sorted(spared)], (u for i, u in enumerate(units) if i not in spared)
            for key, size, p in flight(group):
                if last and 0.0 < p < 1.0:
                    rest.append((key, size, p))
                else:
                    out.append((key[0], key[1], size, p, key[2]))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            for key, size, p, _ in kept:
                if 0.0 < p < 1.0:
                    rest.append((key, size, p))
                else:
                    out.append((key[0], key[1], size, p, key[2]))
            sizes = {k: s for k, s, _ in rest}
            out += [(k[0], k[1], sizes[k], p, k[2]) for k, p in (land(rest) if rest else {}).items()]
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), OUT.types, strict=True)], schema=OUT)

    return run


def cube(units: DataFrame) -> DataFrame:
    """units (uid, grp, size, p, h), h a hash -> (uid, grp, size, p) with every p 0 or 1, balanced within grp."""
    settled = []
    left = units
    largest = left.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-largest // BLOCK)
    while True:
        last = blocks <= 1
        block = F.xxhash64("grp", F.pmod("h", F.lit(max(1, blocks))))
        dealt = left.select(block.alias("block"), "uid", "grp", "size", "p", "h")
        flown = dealt.repartition("block").sortWithinPartitions("block", F.desc("size"), "h", "uid").mapInArrow(_blocks(last), "uid long, grp long, size long, p double, h long")
        flown = materialise(flown, "flight")
        done = (F.col("p") == 0) | (F.col("p") == 1)
        settled.append(flown.filter(done))
        if last:
            break
        left = flown.filter(~done)
        blocks = 1 if 2 * blocks <= BLOCK else -(-2 * blocks // BLOCK)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("uid", "p")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target, copies (0 to `most`), taken = copies * size; all other columns stay."""
    names = ("size", "source_size", "target", "copies", "taken", "_uid", "_h")
    clash = [c for c in docs.columns if c in names]
    # the id is fixed by writing: every later step reads these rows
    sized = docs.drop(*clash).withColumns({"size": word_count(F.col("text")), "_h": F.xxhash64("doc_id", "text") , "_uid": F.monotonically_increasing_id()})
    return mix_sized(materialise(sized, "sized"), weights, most)


def mix_sized(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    per = targets(sized, weights, most)
    joined = sized.select("_uid", "_h", "size", "source").join(F.broadcast(per.filter("source is not null")), "source", "left")
    # the null source has a row of its own
    none = per.filter("source is null").select("source_size", "target", "ratio").first()
    if none:
        for c, v in zip(("source_size", "target", "ratio"), none, strict=True):
            joined = joined.withColumn(c, F.when(F.col("source").isNull(), F.lit(v)).otherwise(F.col(c)))
    whole = F.floor(F.col("ratio") + 1e-12)
    units = joined.select(F.col("_uid").alias("uid"), F.xxhash64(F.coalesce("source", F.lit("\0null")), F.col("source").isNull()).alias("grp"), "size", F.greatest(F.col("ratio") - whole, F.lit(0.0)).alias("p"), F.pmod("_h", F.lit(1 << 62)).alias("h"), "source", "source_size", "target", whole.cast("int").alias("whole"))
    units = materialise(units, "units")
    settled = cube(units.select("uid", "grp", "size", "p", "h"))
    picked = units.join(settled.withColumnRenamed("p", "extra"), "uid").select(F.col("uid").alias("_uid"), "source_size", "target", (F.col("whole") + F.col("extra").cast("int")).alias("copies"))
    out = sized.join(picked, "_uid").drop("_uid", "_h")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_h"), F.monotonically_increasing_id().alias("_uid"))
    return mix_sized(materialise(sized, "sized")).select("doc_id", "size", "source_size", "target", "taken")
