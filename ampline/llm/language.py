"""Language identification (operator 7).

Sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3,
hashed), trained with follow-the-regularised-leader and an elastic net, then
calibrated by a temperature.

Document frequencies cover every learning document. The weights are fitted on a
bounded sample: per language at most PER_LANGUAGE learning documents, chosen by
a hash of id and text, a fifth of which only fits the temperature. Languages are
the non-null values of lang among the learning documents, 1,000 at most.

Null texts and texts without a letter are `und` with score 1; if nothing can be
learned all others are `und` with score 0. Texts are lower-cased and read whole,
in pieces, so memory does not grow with their length. Rows with equal doc_id are
separate rows; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold_column, read_table

#: Hashed n-grams; a power of two.
DIM = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1200
PIECE = 1 << 18
UND = "und"
#: Texts held out that show how strange a language's own texts can be, at least; and what the strangest one's value is multiplied by.
HELD, MARGIN = 20, 1.25

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def counts(text: str) -> np.ndarray:
    """Occurrences of each hashed n-gram of the lower-cased text."""
    total = np.zeros(DIM, np.int64)
    shift = np.uint64(64 - DIM.bit_length() + 1)
    for at in range(0, len(text), PIECE):
        # a piece starts with the last characters of the one before, whose own n-grams are not counted again
        back = min(at, max(ORDERS) - 1)
        c = np.frombuffer(text[at - back : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in ORDERS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, np.uint64(n))
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * _MULT[k % 3]
            total += np.bincount((h[max(0, back - n + 1) :] >> shift).astype(np.int64), minlength=DIM)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values, (1 + ln tf) * idf, of length 1."""
    c = counts(text)
    at = np.flatnonzero(c)
    x = (1 + np.log(c[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, (x / norm if norm else x).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal for softmax loss with l1 and l2 penalties."""

    dim: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3

    def __post_init__(self):
        self.z, self.n = np.zeros((self.dim, self.classes)), np.zeros((self.dim, self.classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UND, 1.0
        if not self.langs:
            return UND, 0.0
        at, x = vector(text, self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The T that gives softmax(logits / T) the least log loss, by golden-section search over ln T."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for b in batches:
        for t in b.column(0):
            df += counts(t.as_py()) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tolist()], pa.list_(pa.int64()))], names=["n", "df"])


def train(docs: DataFrame, epochs: int = 3, per_language: int = PER_LANGUAGE) -> Model:
    """docs(text, lang): the learning documents."""
    known = docs.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    known = known.withColumn("h", F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)))
    # every document: sums of one vector per task, added by position
    parts = known.select("text").mapInArrow(_frequencies, "n long, df array<long>")
    sums = parts.select("n", F.posexplode("df").alias("at", "df")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).toArrow().to_pandas()  # not as rows: the driver would hold an object for each
    idf = np.ones(DIM)
    if len(sums):
        idf[sums["at"]] = np.log((1 + sums["n"]) / (1 + sums["df"])) + 1
    totals = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1000).collect()
    langs = sorted(r["lang"] for r in totals)
    if not langs:
        return Model([], idf, np.zeros((DIM, 0)), 1.0)
    below = F.create_map(*[F.lit(v) for r in totals for v in (r["lang"], int(min(1.0, 1.1 * per_language / r["count"]) * (1 << 30)))])
    sample = known.filter(F.col("h") <= below[F.col("lang")]).select("lang", "text", "h")
    width = 2 * per_language * len(langs)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text, h in zip(*b.columns, strict=True):
                at, x = vector(text.as_py(), idf)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([h.as_py()]), pa.array([at.astype("<u2").tobytes()]), pa.array([x.astype("<f2").tobytes()])], names=["lang", "h", "at", "x"])

    rows = sample.mapInArrow(vectors, "lang string, h long, at binary, x binary").orderBy("h").limit(width).collect()
    place = {lang: k for k, lang in enumerate(langs)}
    data = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f2").astype(np.float32), place[r["lang"]]) for r in rows]
    del rows
    fit, held = [d for i, d in enumerate(data) if i % 5], data[::5]
    model = Ftrl(DIM, len(langs))
    for _ in range(epochs):
        for at, x, label in fit:
            model.learn(at, x, label)
    w = model.weights().astype(np.float32)
    logits = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), len(langs))
    return Model(langs, idf.astype(np.float32), w, temperature(logits, np.array([k for *_, k in held], int)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of any columns of these names."""
    kept = docs.drop(*[c for c in docs.columns if c in ("lang_pred", "score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, StructType([*kept.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold_column(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out).select("text", "lang"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@dataclass
class Known:
    """How usual the n-grams of each language's texts are, and the least that its held-out texts show."""

    logs: dict[str, np.ndarray]
    least: dict[str, float]

    def usual(self, text: str, lang: str) -> float:
        """Mean log share of the language's texts that have an n-gram, over the n-grams of the text.

        Words with a digit or @ (numbers, addresses, keys) are left out, unless under ten letters remain.
        """
        plain = " ".join(w for w in text.split() if "@" not in w and not any(map(str.isdigit, w)))
        c = counts(plain if sum(map(str.isalpha, plain)) >= 10 else text)
        return float(c @ self.logs[lang] / max(1, c.sum()))


def known(docs: DataFrame, model: Model, per_language: int = PER_LANGUAGE) -> Known:
    """docs(text, lang): the learning documents. A fifth of a bounded sample of each language is held out.

    A language with fewer than HELD texts held out takes the least value of all languages; with fewer than
    HELD in all, nothing is judged.
    """
    own = docs.filter("text is not null").select("text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isin(model.langs)).withColumn("h", F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)))
    totals = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not totals:
        return Known({}, {})
    below = F.create_map(*[F.lit(v) for k, n in totals.items() for v in (k, int(min(1.0, per_language / n) * (1 << 30)))])
    sample = own.filter(F.col("h") <= below[F.col("lang")])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if has_letter(t := text.as_py()):
                    n, df = sums.setdefault(lang, [0, np.zeros(DIM, np.int64)])
                    df += counts(t) > 0
                    sums[lang][0] = n + 1
        for lang, (n, df) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n]), pa.array([df.tolist()], pa.list_(pa.int64()))], names=["lang", "n", "df"])

    parts = sample.filter("h % 5 <> 0").select("lang", "text").mapInArrow(frequencies, "lang string, n long, df array<long>")
    sums = parts.select("lang", "n", F.posexplode("df").alias("at", "df")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).toArrow().to_pandas()
    logs = {}
    for lang, g in sums.groupby("lang"):
        logs[lang] = np.empty(DIM, np.float32)
        logs[lang][g["at"]] = np.log((g["df"] + 0.5) / (g["n"] + 1))
    shared = docs.sparkSession.sparkContext.broadcast(Known(logs, {}))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x, shared.value.usual(t, x)) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x in shared.value.logs and has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["lang", "usual"])

    held = sample.filter("h % 5 = 0").select("lang", "text").mapInArrow(score, "lang string, usual double")
    found = held.groupBy("lang").agg(F.min("usual").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    if sum(r["n"] for r in found) < HELD:
        return Known(logs, {})
    least = dict.fromkeys(logs, MARGIN * min(r["least"] for r in found))
    least |= {r["lang"]: MARGIN * r["least"] for r in found if r["n"] >= HELD}
    return Known(logs, least)


def of_known_language(docs: DataFrame, seen: Known, text: str = "text") -> DataFrame:
    """docs(text, lang_pred) without the texts that are stranger than any held out of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    at, lang = docs.columns.index(text), docs.columns.index("lang_pred")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(at), b.column(lang).to_pylist(), strict=True)
            keep = [x not in shared.value.least or shared.value.usual(t.as_py(), x) >= shared.value.least[x] for t, x in rows]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
