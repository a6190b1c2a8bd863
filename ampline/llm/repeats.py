"""Removal of repeated byte strings (operator 3).

Every byte is removed that lies in a WIDTH-byte string which starts anywhere
else too, in the same text or another.

The construction is blockwise with a difference cover, in bounded memory:

1. Cover sample. Of the positions modulo PERIOD only the residues of a difference
   cover are sampled. For any two positions some shift below PERIOD brings both
   to sampled residues, so two equal WIDTH-byte strings hold equal sample strings
   of SAMPLE = WIDTH - PERIOD + 1 bytes at the same place. Samples are ranked
   against each other, one bucket at a time; a string is a candidate only if it
   holds a sample that occurs again. This rules out all others.
2. Suffix buckets. Candidates are sorted by the name of their first WIDTH bytes,
   one block of buckets after the other and one bucket in memory at a time, and
   equal neighbours are marked. Blocks are sized by the texts, so the scratch space
   is a share of the input. A chunk of texts names a string once however often it
   has it, so a passage that a third of all texts share is one entry per chunk; a
   bucket answers with one bit per entry.
3. Each chunk maps the bits back to its positions and cuts the covered bytes.

Names are values of the string as a polynomial modulo 2^61 - 1 at points drawn at
random for each run: one point for samples, which only nominate, two for
candidates. Two different strings share both values with a probability of at most
(400 / 2^61)^2, whatever the texts; as the points aren't known before, no text can
be built that collides. Over all pairs of 100 TB of positions that is below 1 in 5,000
in total, and below 1 in 10^10 for 30 GB. Buckets are ranges of names.

Equal texts are one text for all of this; if there are two or more of them and
they have WIDTH bytes or more, all their bytes go.

Null text counts as empty. Texts under WIDTH bytes stay whole. Texts are UTF-8
bytes, handled in pieces, so memory doesn't grow with their length beyond the
text. Rows with equal doc_id are separate rows; extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read_table, shared_dir

WIDTH = 400
#: A prime; the cover has ORDER + 1 of ORDER^2 + ORDER + 1 residues.
ORDER = 13
PERIOD = ORDER * ORDER + ORDER + 1
SAMPLE = WIDTH - PERIOD + 1
#: Bytes named at once.
PIECE = 1 << 18
#: Text bytes of a chunk, about, and strings that it names at once, at most.
CHUNK, UNIT = 1 << 21, 1 << 21
#: Names of a bucket, about.
BUCKET = 1 << 20
#: Files of the texts at most (Spark's own limit on buckets of a table).
FILES = 100_000
#: Names of a block of buckets, in bytes, for each byte of text.
SHARE = 0.4

PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30, _LOW32 = (np.uint64(x) for x in (PRIME, (1 << 31) - 1, (1 << 30) - 1, (1 << 32) - 1))
_U = {n: np.uint64(n) for n in (1, 30, 31, 32, 61)}


def difference_cover(order: int = ORDER) -> np.ndarray:
    """Residues modulo order^2 + order + 1 (order prime) whose differences are all others, each once.

    Singer's construction: powers of the root of a cubic over the field of `order` elements that lie in a plane.
    """
    period = order * order + order + 1
    for a, b, c in product(range(order), repeat=3):
        x, at = (1, 0, 0), []
        for i in range(period):
            if x[2] == 0:
                at.append(i)
            x = (x[2] * a % order, (x[0] + x[2] * b) % order, (x[1] + x[2] * c) % order)
        if len(at) == order + 1 and len({(p - q) % period for p in at for q in at}) == period:
            return np.array(at, np.int64)
    raise ValueError(f"{order} is not prime")


_COVER = difference_cover()


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> _U[61]) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME for values below it."""
    xh, xl, yh, yl = x >> _U[31], x & _LOW31, y >> _U[31], y & _LOW31
    middle = xl * yh + xh * yl
    return _reduced(((xh * yh) << _U[1]) + (middle >> _U[30]) + ((middle & _LOW30) << _U[31]) + xl * yl)


class Point:
    """A point at which strings are evaluated, with its powers and their inverses."""

    def __init__(self, value: int):
        self.value = value
        self.powers, self.inverse = self._powers(value), self._powers(pow(value, -1, PRIME))
        self.low, self.high = self.powers & _LOW32, self.powers >> _U[32]

    @staticmethod
    def _powers(base: int, n: int = PIECE + WIDTH) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), PRIME)))])
        return out[:n]


_points: dict[int, Point] = {}


def point(value: int) -> Point:
    if value not in _points:
        if len(_points) > 8:
            _points.clear()
        _points[value] = Point(value)
    return _points[value]


def window_names(b: np.ndarray, width: int, value: int, at: np.ndarray | None = None) -> np.ndarray:
    """Of each width-byte window of b (at most PIECE + width - 1 bytes), or of those at `at`: sum of b[k] value^k."""
    p, n = point(value), len(b)
    b = b.astype(np.uint64)
    low, high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(b * p.low[:n], out=low[1:])  # below 2^40 each, so sums of 2^19 fit
    np.cumsum(b * p.high[:n], out=high[1:])
    if at is None:
        low, high, inverse = low[width:] - low[:-width], high[width:] - high[:-width], p.inverse[: n - width + 1]
    else:
        low, high, inverse = low[at + width] - low[at], high[at + width] - high[at], p.inverse[at]
    return times(_reduced(times(high, np.uint64(1 << 32)) + _reduced(low)), inverse)


def sample_names(text: bytes, value: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions and their names."""
    b, at, names = np.frombuffer(text, np.uint8), [], []
    step = PIECE // PERIOD * PERIOD
    for a in range(0, len(b) - SAMPLE + 1, step):
        part = b[a : a + step + SAMPLE - 1]
        own = (np.arange(0, len(part), PERIOD)[:, None] + _COVER).ravel()
        own = own[own <= len(part) - SAMPLE]
        at.append(own + a)
        names.append(window_names(part, SAMPLE, value, own))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(names)


def ranges(samples: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Starts (from, to) of the WIDTH-byte strings of n bytes that hold a sample, merged; samples ascend."""
    lo, hi = np.maximum(samples - PERIOD + 1, 0), np.minimum(samples, n - WIDTH) + 1
    lo, hi = lo[lo < hi], hi[lo < hi]
    if not len(lo):
        return []
    new = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    return list(zip(lo[np.r_[0, new]].tolist(), hi[np.r_[new - 1, len(lo) - 1]].tolist(), strict=True))


def units(runs: list[tuple[int, int, int]], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (text, from, to) cut into lists that name `most` strings each."""
    own, held = [], 0
    for text, a, z in runs:
        while a < z:
            q = min(z, a + most - held)
            own.append((text, a, q))
            held += q - a
            a = q
            if held == most:
                yield own
                own, held = [], 0
    if own:
        yield own


def run_names(texts: list[bytes], runs: list[tuple[int, int, int]], values: tuple[int, ...]) -> list[np.ndarray]:
    """Names, one array for each value, of the WIDTH-byte strings at all positions of the runs."""
    out: list[list[np.ndarray]] = [[] for _ in values]
    for i, a, z in runs:
        b = np.frombuffer(texts[i], np.uint8)
        for p in range(a, z, PIECE):
            part = b[p : min(z, p + PIECE) + WIDTH - 1]
            for own, v in zip(out, values, strict=True):
                own.append(window_names(part, WIDTH, v))
    return [np.concatenate(x) for x in out]


def sort_names(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of names and which of them, in order, differ from the one before."""
    order = np.argsort(names[0])
    new = np.ones(len(order), bool)
    if len(names) > 1:
        a, b = names[0][order], names[1][order]
        tie = a[1:] == a[:-1]
        if (tie & (b[1:] != b[:-1])).any():
            order = np.lexsort(names[::-1])
    sorted_ = [n[order] for n in names]
    new[1:] = np.logical_or.reduce([s[1:] != s[:-1] for s in sorted_])
    return order, new


def entries(names: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct names in order; where each position's is among them; whether it occurs twice or more."""
    order, new = sort_names(names)
    index = np.cumsum(new) - 1
    place = np.empty(len(order), np.int64)
    place[order] = index
    return [n[order[new]] for n in names], place, np.bincount(index, minlength=0) > 1


def cut(text: bytes, starts: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and runs removed, and what is left, if WIDTH bytes go from each start (ascending)."""
    if not len(starts):
        return 0, 0, text
    gap = np.flatnonzero(np.diff(starts) > WIDTH)
    lo, hi = starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + WIDTH
    kept, at = [], 0
    for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
        kept.append(text[at:a])
        at = z
    kept.append(text[at:])
    return int((hi - lo).sum()), len(lo), b"".join(kept)


ASKED = "bucket int, chunk long, unit int, names binary, many binary"


def _questions(chunk: int, unit: int, names: list[np.ndarray], buckets: int, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """One row for each bucket from `first` to `last` of which the unit has names."""
    width = -(-PRIME // buckets)
    if last is not None:
        own = (names[0] >= np.uint64(first * width)) & (names[0] < np.uint64(min(last * width, PRIME)))
        names = [n[own] for n in names]
    distinct, _, many = entries(names)
    bucket = (distinct[0] // np.uint64(width)).astype(np.int32)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)].tolist() if len(bucket) else []
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[a]), chunk, unit, b"".join(d[a:z].tobytes() for d in distinct), np.packbits(many[a:z]).tobytes()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("unit", pa.int32()), ("names", pa.binary()), ("many", pa.binary())])


def _answer(kinds: int):
    """Rows come sorted by bucket; one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            blobs = [np.frombuffer(n, np.uint64).reshape(kinds, -1) for *_, n, _ in held]
            sizes = [x.shape[1] for x in blobs]
            order, new = sort_names([np.concatenate([x[k] for x in blobs]) for k in range(kinds)])
            again = ~new
            again[:-1] |= ~new[1:]
            hit = np.zeros(len(order), bool)
            hit[order[again]] = True
            bits, at = [], 0
            for n, (*_, many) in zip(sizes, held, strict=True):
                bits.append(np.packbits(hit[at : at + n] | np.unpackbits(np.frombuffer(many, np.uint8), count=n).astype(bool)).tobytes())
                at += n
            cols = [pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.int32()), pa.array([h[0] for h in held], pa.int32()), pa.array(bits, pa.binary()), pa.array(sizes, pa.int32())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "unit", "bucket", "bits", "size"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return run


def _answers(asked: DataFrame, kinds: int, tag: str) -> DataFrame:
    """Marks the names that a second unit has, or that are marked as occurring twice in one."""
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    return materialise(dealt.mapInArrow(_answer(kinds), "chunk long, unit int, bucket int, bits binary, size int"), tag)


def _texts(t: pa.Table) -> tuple[list[bytes], list[bytes]]:
    """Digests and bodies of a chunk, in the order of digests."""
    rows = sorted(zip(t.column("digest").to_pylist(), t.column("body").to_pylist(), strict=True))
    return [r[0] for r in rows], [r[1] for r in rows]


def _bits(notes: list[dict], unit: int) -> np.ndarray:
    own = sorted((n for n in notes if n["unit"] == unit and n["bits"] is not None), key=lambda n: n["bucket"])
    return np.concatenate([np.unpackbits(np.frombuffer(n["bits"], np.uint8), count=n["size"]) for n in own]).astype(bool) if own else np.zeros(0, bool)


def _runs(digests: list[bytes], notes: list[dict]) -> list[tuple[int, int, int]]:
    """Runs (text, from, to) of candidate strings."""
    at = {n["digest"]: n for n in notes if n["digest"] is not None}
    return [(i, a, z) for i, d in enumerate(digests) if d in at for a, z in zip(at[d]["lo"], at[d]["hi"], strict=True)]


def removals(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept_chars (characters that begin in what is left)."""
    spark, most = docs.sparkSession, UNIT
    values = tuple(secrets.randbelow(PRIME - 1000) + 500 for _ in range(3))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", text.cast("binary").alias("body"), F.length(text).cast("bigint").alias("chars")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    heads = materialise(own.select("doc_id", "digest", F.length("body").cast("bigint").alias("n_bytes"), "chars"), "heads")
    total = heads.agg(F.sum("n_bytes")).first()[0] or 0
    files = min(FILES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 25))))
    n_chunks = max(1, total // CHUNK)
    # distinct texts, in files by chunk: grouping by the chunk leaves them where they are from here on
    table = f"texts_{uuid.uuid4().hex}"
    chunk = F.pmod(F.xxhash64("digest"), F.lit(n_chunks)).alias("chunk")
    long = own.filter(F.length("body") >= WIDTH).select(chunk, "digest", "body").repartition(files, "chunk").dropDuplicates(["chunk", "digest"])
    long.write.bucketBy(files, "chunk").sortBy("chunk").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    texts = spark.table(table)
    spark._jvm.System.gc()
    by_chunk = lambda df: df.groupBy("chunk")
    samples = total * len(_COVER) // PERIOD
    sample_buckets = max(1, -(-samples // BUCKET))

    def sampled(bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [sample_names(t, values[0]) for t in bodies]

    def ask_samples(key, t):
        names = np.concatenate([h for _, h in sampled(_texts(t)[1])])
        return _table(list(_questions(key[0].as_py(), 0, [names], sample_buckets)), ASKED_ARROW)

    ranked = _answers(by_chunk(texts).applyInArrow(ask_samples, ASKED), 1, "ranks")

    def find(key, t, a):
        """Ranges of the candidates of each text."""
        digests, bodies = _texts(t)
        found = sampled(bodies)
        _, place, _ = entries([np.concatenate([h for _, h in found])])
        hit, rows, at = _bits(a.to_pylist(), 0)[place], [], 0
        for d, body, (p, _) in zip(digests, bodies, found, strict=True):
            if own := ranges(p[hit[at : at + len(p)]], len(body)):
                rows.append((key[0].as_py(), d, [a for a, _ in own], [z for _, z in own]))
            at += len(p)
        return _table(rows, pa.schema([("chunk", pa.int64()), ("digest", pa.binary()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))]))

    candidates = by_chunk(texts).cogroup(by_chunk(ranked)).applyInArrow(find, "chunk long, digest binary, lo array<long>, hi array<long>")
    candidates = materialise(candidates, "candidates")
    discard(ranked)
    n = candidates.agg(F.sum(F.aggregate(F.arrays_zip("lo", "hi"), F.lit(0).cast("bigint"), lambda s, r: s + r["hi"] - r["lo"]))).first()[0] or 0
    blocks = max(1, -(-16 * n // int(SHARE * total + 1)))
    buckets = blocks * max(1, -(-n // (BUCKET * blocks)))
    notes = candidates.select("chunk", F.lit(None).cast("int").alias("unit"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("int").alias("size"), "digest", "lo", "hi")
    answered = []

    def asking(first: int, last: int):
        def ask(key, t, a):
            digests, bodies = _texts(t)
            rows = []
            for k, unit in enumerate(units(_runs(digests, a.to_pylist()), most)):
                rows += _questions(key[0].as_py(), k, run_names(bodies, unit, values[1:]), buckets, first, last)
            return _table(rows, ASKED_ARROW)

        return ask

    for block in range(blocks if n else 0):
        ask = asking(block * buckets // blocks, (block + 1) * buckets // blocks)
        answered.append(_answers(by_chunk(texts).cogroup(by_chunk(candidates)).applyInArrow(ask, ASKED), 2, "answers"))
        notes = notes.unionByName(answered[-1], allowMissingColumns=True)

    def apply(key, t, a):
        digests, bodies = _texts(t)
        known = a.to_pylist()
        starts: list[list[np.ndarray]] = [[] for _ in bodies]
        for k, unit in enumerate(units(_runs(digests, known), most)):
            _, place, _ = entries(run_names(bodies, unit, values[1:]))
            hit, at = _bits(known, k)[place], 0
            for i, p, q in unit:
                starts[i].append(np.flatnonzero(hit[at : at + q - p]) + p)
                at += q - p
        rows = []
        for d, body, s in zip(digests, bodies, starts, strict=True):
            gone = np.concatenate(s) if s else np.zeros(0, np.int64)
            if len(gone):
                removed, spans, kept = cut(body, gone)
                begin = int(((np.frombuffer(kept, np.uint8) & 0xC0) != 0x80).sum())
                rows.append((d, removed, spans, hashlib.sha256(kept).hexdigest(), begin))
        return _table(rows, pa.schema([("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_chars", pa.int64())]))

    results = by_chunk(texts).cogroup(by_chunk(notes)).applyInArrow(apply, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept_chars long")
    results = materialise(results, "removed")
    discard(candidates, texts, *answered)
    spark.sql(f"DROP TABLE {table}")
    copies = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    known = materialise(results.join(copies, "digest", "full"), "known")
    out = heads.join(known, "digest", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= WIDTH)
    zero = F.lit(0).cast("bigint")
    removed = F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero))
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.when(whole, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        (F.col("n_bytes") - removed).alias("n_kept"), F.when(whole, zero).otherwise(F.coalesce("kept_chars", "chars")).alias("kept_chars"),
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read_table(spark, sf_dir, "documents"))
