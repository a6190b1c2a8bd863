"""SimHash near-duplicates found with BK-trees (operator 9).

A fingerprint has a bit set where over half of a text's shingle hashes have it.
Fingerprints of at most `radius` differing bits are linked; a component is what
links reach.

Distinct fingerprints are cut into blocks of bits so that any two within the
radius agree on some blocks in full; fingerprints that agree on such blocks form
a shard. Each shard's BK-tree (children keyed by their distance to the parent)
is built and searched in one task, following only the edges within the radius;
links are reduced to a forest as they are found, so a shard gives fewer edges
than it has fingerprints. A shard above TREE fingerprints becomes several trees,
and each pair of its trees is a task of its own: nothing is left out and no task
holds more than two trees' fingerprints. Trees go to the tasks that search them
by shuffle instead of by broadcast, as the number of shards grows with the data.

A text without words (null included) has fingerprint zero, linked like any
other. Copies share a fingerprint and are one node. Rows with equal doc_id are
separate rows; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, words_of
from .graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a tree at most.
TREE = 4096
#: Fingerprints expected in a shard at most, by which the cut into blocks is chosen.
SHARD = 256


def simhash(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(width, len(words))
    digest, total, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        hashed = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts[at:to], starts[at + width : to + width], strict=True)])
        total += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t.as_py()) for t in b.column(1)], pa.int64())], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str) -> DataFrame:
    """(key, fp) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(_hashed, f"key {kind}, fp long")


def blocks_for(n: int, radius: int = RADIUS, shard: int = SHARD) -> list[list[tuple[int, int]]]:
    """Sets of bit ranges (shift, width): two fingerprints within the radius agree on all ranges of some set.

    64 bits are cut into radius + extra blocks; `extra` of them stay untouched by any `radius` changes.
    """
    for extra in range(1, 6):
        count = radius + extra
        cuts = [64 * i // count for i in range(count + 1)]
        ranges = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        sets = [list(c) for c in combinations(ranges, extra)]
        if n / 2 ** min(sum(w for _, w in s) for s in sets) <= shard:
            break
    return sets


def _shard_keys(fp: Column, sets: list[list[tuple[int, int]]]) -> Column:
    keys = []
    for k, ranges in enumerate(sets):
        bits = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in ranges]
        keys.append(F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *bits).alias("shard")))
    return F.array(*keys)


class Tree:
    """BK-tree of integers under Hamming distance."""

    def __init__(self):
        self.root: list | None = None

    def add_and_find(self, x: int, radius: int) -> list[int]:
        """Members within the radius of x; x is then a member."""
        if self.root is None:
            self.root = [x, {}]
            return []
        found, stack = [], [self.root]
        while stack:
            value, children = stack.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if len(children) <= 2 * radius + 1:
                stack += [c for at, c in children.items() if d - radius <= at <= d + radius]
            else:
                stack += [children[at] for at in range(d - radius, d + radius + 1) if at in children]
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            if d not in node[1]:
                node[1][d] = [x, {}]
                return found
            node = node[1][d]


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (member, root) of the components of distinct 64-bit values, found with a BK-tree."""
    if len(values) < 2:
        return []
    mask, tree, up = (1 << 64) - 1, Tree(), {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for v in values:
        x = v & mask
        up[x] = x
        for y in tree.add_and_find(x, radius):
            a, b = find(x), find(y)
            if a != b:
                up[a] = b
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(x), signed(r)) for x in up if (r := find(x)) != x]


def _links(radius: int):
    """Rows (cell, fp) come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, values = None, []

        def out(values):
            edges = forest(values, radius)
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cells, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if cells[i] != cell:
                    yield from out(values)
                    cell, values = cells[i], []
                values += fps[i:j].tolist()
        yield from out(values)

    return run


def links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """fps(fp), distinct -> edges (a, b) with the components of `radius` links; fewer than all links, but connecting the same."""
    sets = blocks_for(fps.count(), radius)
    rows = fps.select("fp", F.explode(_shard_keys(F.col("fp"), sets)).alias("s")).select("fp", "s.shard")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a shard of one has no links; larger ones are dealt as a grid of pairs of trees
    rows = rows.join(sizes, "shard").withColumn("g", F.ceil(F.col("n") / tree).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    cells = rows.select("fp", "shard", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    cells = cells.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius), "a long, b long").distinct()


def classes(hashed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hashed(key, fp) -> (fp, first): every fingerprint's smallest key of its component."""
    fps = materialise(hashed.groupBy("fp").agg(F.min("key").alias("first")), "fps")
    label = components(links(fps.select("fp"), radius))
    joined = fps.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    firsts = joined.groupBy("label").agg(F.min("first").alias("component"))
    return materialise(joined.join(firsts, "label").select("fp", F.col("component").alias("first")), "classes")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = materialise(fingerprints(read_table(spark, sf_dir, "documents"), "doc_id"), "simhash")
    out = hashed.join(classes(hashed).hint("merge"), "fp")
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))
