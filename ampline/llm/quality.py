"""Quality classifier: a factorisation machine (operator 4).

Features are hashed words, statistics of the text's structure and one of the
row's metadata (its recorded length). Pairwise interactions have rank RANK and
are summed in linear time: half of (sum of v x)^2 less the sum of (v x)^2.

The machine is fitted on a bounded sample of labelled learning rows (at most
SAMPLE, chosen by a hash of the id); every document is scored, whole. Where a
document has several labels their mean is learned. Without any labels every
score is 0.5.

Null text counts as empty; empty texts are scored by their statistics. Rows with
equal doc_id are separate rows; extra columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_column, read_table

#: Hashed words; a power of two. Statistics and metadata follow them.
WORDS = 1 << 16
RANK = 8
SAMPLE = 8000
THRESHOLD = 0.7

_KINDS = np.zeros((256, 8), np.float64)  # of bytes: upper, lower, digit, white space, line end, stop, other sign, beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _k = 7 if _b > 127 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 5 if _c in ".,;:?'-\"" else 6
    _KINDS[_b, _k] = 1

#: Bins that each statistic is dealt to.
BINS = 12
STATS = 15
DIM = WORDS + STATS * BINS


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = Counter(raw.lower().split())
    n = sum(words.values())
    size = len(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / max(1, size)
    lines = raw.count(b"\n") + 1
    tops = words.most_common(1)
    ended = sum(raw.count(c) for c in (b".\n", b". ")) / max(1, n)
    doubled = sum(raw.count(c + c) for c in (b"!", b"#", b"$", b"%", b"&", b"*")) / max(1, n)
    bars = raw.count(b"|") / max(1, n)
    known = size if n_chars is None else n_chars
    shares = [*kinds, len(words) / max(1, n), (tops[0][1] if tops else 0) / max(1, n), ended, doubled, bars]
    scaled = [min(BINS - 1, int(BINS * min(1.0, s) ** 0.5)) for s in shares]
    scaled += [min(BINS - 1, int(np.log1p(size / lines))), min(BINS - 1, int(np.log1p(max(0, known))))]
    at = np.array([*(zlib.crc32(w) & (WORDS - 1) for w in words), *(WORDS + BINS * i + b for i, b in enumerate(scaled))], np.int64)
    tf = 1 + np.log(np.array([*words.values()], np.float64)) if words else np.zeros(0)
    norm = np.sqrt(tf @ tf)
    x = np.concatenate([tf / norm if norm else tf, np.full(STATS, STATS**-0.5)])
    return at, x


class Machine:
    def __init__(self, dim: int = DIM, rank: int = RANK, seed: int = 7, rate: float = 0.1, l2: float = 1e-5):
        self.bias, self.w, self.v = 0.0, np.zeros(dim, np.float32), np.random.default_rng(seed).normal(0, 0.05, (dim, rank)).astype(np.float32)
        self.rate, self.l2 = rate, l2

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x), -30, 30))))

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 6, seed: int = 11) -> None:
        """Logistic loss, AdaGrad."""
        gw, gv, gb = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(data)):
                at, x, y = data[i]
                d = self.score(at, x) - y
                own = self.v[at]
                s = (own * x[:, None]).sum(0)
                dw = d * x + self.l2 * self.w[at]
                dv = d * x[:, None] * (s - own * x[:, None]) + self.l2 * own
                gw[at] += dw * dw
                gv[at] += dv * dv
                gb += d * d
                self.w[at] -= self.rate * dw / np.sqrt(gw[at])
                self.v[at] = own - 0.3 * self.rate * dv / np.sqrt(gv[at])
                self.bias -= self.rate * d / gb**0.5


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine | None:
    """docs(doc_id, text, n_chars), labels(doc_id, quality), learning rows only."""
    labels = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y")).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    n = labels.count()
    if not n:
        return None
    chosen = labels.filter(F.col("h") <= int(min(1.0, 1.05 * most / n) * (1 << 30))).orderBy("h", "doc_id").limit(most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, n_chars, y, h in zip(*b.columns, strict=True):
                at, x = features(text.as_py(), n_chars.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([y.as_py()]), pa.array([h.as_py()]), pa.array([at.astype("<i4").tobytes()]), pa.array([x.astype("<f4").tobytes()])], names=["y", "h", "at", "x"])

    # `most` rows of two numbers: bounded whatever the tables' size
    found = docs.join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("string"), F.col("n_chars").cast("bigint"), "y", "h")
    rows = found.mapInArrow(vectors, "y double, h long, at binary, x binary").orderBy("h").limit(2 * most).collect()
    data = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4"), r["y"]) for r in rows]
    machine = Machine()
    machine.fit(data)
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """docs(doc_id, held_out, text, n_chars) -> doc_id, held_out, score."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [m.score(*features(t.as_py(), n.as_py())) if m else 0.5 for t, n in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", F.col("text").cast("string"), F.col("n_chars").cast("bigint")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold_column(F.col("doc_id"), 4) == 2
    machine = train(docs.filter(~held_out).select("doc_id", "text", "n_chars"), labels.filter(~held_out).select("doc_id", "quality"))
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text", "n_chars"), machine)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
