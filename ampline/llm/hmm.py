"""Hidden Markov language model (operator 2).

Tokens are lower-cased (A-Z) words and one end. Each token belongs to a class:
the HEAD most frequent words and the end are classes of their own, all other
words, unseen ones included, are dealt to RARE classes by their first and last
two bytes. Latent states emit classes; within a rare class a word has
probability (c + 1) / (n + v + 1), c its count, n and v the class's tokens and
distinct words, so that the model is a distribution over all texts.

Word counts come from all learning documents, and so does the model: Baum-Welch
first goes through all of them in BLOCKS blocks by hash, with a new model after
each block from its expected counts and the earlier blocks', which count FADE
times as much for each block that follows. Then each of FULL rounds gathers
expected counts from every learning document. Counts are gathered per partition
and added up. Class sequences are made once and read again by each step.
A text's likelihood is exact: the scaled forward recursion over all its tokens.

Frequent words are looked up in a broadcast table of HEAD rows whatever the
corpus; the counts of all others are joined by shuffle, where no key is frequent.

Null and empty texts are one end. Rows with equal doc_id are separate rows.
Without learning documents N = V = 0 and every text scores by the uniform model.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold_column, materialise, read_table, words_of

STATES = 8
HEAD = 65_536
RARE = 1024
BLOCKS = 8
FADE = 0.5
FULL = 1
#: Tokens held at once.
CHUNK = 1 << 19
#: Least weight of the class unigram in a state's emissions, in tokens; the classes that it emits add theirs.
PRIOR = 100.0


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[:2] + word[-2:]) % RARE


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts; each task adds up what it has before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > 400_000:
                    yield batch(seen)
                    seen = Counter()
        if seen:
            yield batch(seen)

    def batch(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    head: dict[bytes, int]
    head_counts: np.ndarray
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    ends: int

    @property
    def classes(self) -> int:
        return len(self.head) + RARE + 1

    @property
    def tokens(self) -> int:
        return int(self.head_counts.sum() + self.rare_tokens.sum()) + self.ends

    @property
    def distinct(self) -> int:
        return len(self.head) + int(self.rare_words.sum()) + (self.ends > 0)

    def class_counts(self) -> np.ndarray:
        """Tokens of each class, and one more for a class's words to come."""
        return np.concatenate([self.head_counts, self.rare_tokens + 1, [self.ends + 1]]).astype(np.float64)

    def encode(self, words: list[bytes]) -> list[int]:
        get, h = self.head.get, len(self.head)
        return [k if (k := get(w)) is not None else h + rare_class(w) for w in words]


def vocabulary(counts: DataFrame, ends: int, head: int = HEAD) -> Vocabulary:
    """counts: materialised. Brings `head` rows and RARE sums to the driver."""
    top = counts.orderBy(F.desc("c"), "word").limit(head).collect()
    names = [bytes(r["word"]) for r in top]
    n, v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    ends_of = F.crc32(F.concat(F.substring("word", 1, 2), F.substring("word", -2, 2)))
    for r in counts.groupBy((ends_of % RARE).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    for r, w in zip(top, names, strict=True):
        n[rare_class(w)] -= r["c"]
        v[rare_class(w)] -= 1
    return Vocabulary({w: i for i, w in enumerate(names)}, np.array([r["c"] for r in top], np.int64), n, v, ends)


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @staticmethod
    def initial(vocab: Vocabulary, states: int = STATES, seed: int = 3) -> Hmm:
        rng = np.random.default_rng(seed)
        unigram = vocab.class_counts() / vocab.class_counts().sum()
        emit = unigram[:, None] * rng.uniform(0.5, 1.5, (vocab.classes, states))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, (emit / emit.sum(0)).astype(np.float32))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, vocab: Vocabulary) -> Hmm:
        unigram = vocab.class_counts() / vocab.class_counts().sum()
        emit = emit + (PRIOR + np.minimum(emit, 1).sum(0)) * unigram[:, None]
        return Hmm((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), (emit / emit.sum(0)).astype(np.float32))


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences sorted longest first: how many reach each step, and where each step begins in step-major order."""
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1), "left")
    return active, np.concatenate([[0], np.cumsum(active)])


def _major(seqs: list[np.ndarray], active: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.empty(begin[-1], np.int64)
    for i, s in enumerate(seqs):
        out[begin[: len(s)] + i] = s
    return out


def forward(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """ln likelihood of each class sequence, by the scaled forward recursion."""
    return _forward(model, seqs, False)[0]


def _forward(model: Hmm, seqs: list[np.ndarray], keep: bool):
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    seqs = [seqs[i] for i in order]
    active, begin = _steps(np.array([len(s) for s in seqs]))
    symbols = _major(seqs, active, begin)
    scale = np.empty(len(symbols), np.float32)
    alphas = np.empty((len(symbols), len(model.start)), np.float32) if keep else None
    move, alpha = model.move.astype(np.float32), np.broadcast_to(model.start.astype(np.float32), (len(seqs), len(model.start)))
    emit = model.emit
    for t, n in enumerate(active.tolist()):
        a, b = begin[t], begin[t] + n
        alpha = (alpha[:n] @ move if t else alpha) * emit[symbols[a:b]]
        c = alpha.sum(1)
        alpha = alpha / c[:, None]
        scale[a:b] = c
        if keep:
            alphas[a:b] = alpha
    total = np.zeros(len(seqs))
    logs = np.log(scale.astype(np.float64))
    for t, n in enumerate(active.tolist()):
        total[:n] += logs[begin[t] : begin[t] + n]
    out = np.empty(len(seqs))
    out[order] = total
    return out, alphas, scale, symbols, active, begin


def expected(model: Hmm, seqs: list[np.ndarray], classes: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: ln likelihood and Baum-Welch's expected starts, moves and emissions."""
    total, alphas, scale, symbols, active, begin = _forward(model, seqs, True)
    states = len(model.start)
    move, moves = model.move.astype(np.float32), np.zeros((states, states))
    beta = np.zeros((0, states), np.float32)
    gamma = alphas  # overwritten from the end
    start = np.zeros(states)
    for t in range(len(active) - 1, -1, -1):
        n, a = active[t], begin[t]
        if len(beta) < n:  # sequences that end here
            beta = np.concatenate([beta, np.ones((n - len(beta), states), np.float32)])
        alpha = alphas[a : a + n].copy()
        gamma[a : a + n] = alpha * beta
        if t:
            # what flows from step t-1 over each move
            m = model.emit[symbols[a : a + n]] * beta / scale[a : a + n, None]
            before = alphas[begin[t - 1] : begin[t - 1] + n]
            moves += move * (before.T @ m)
            beta = m @ move.T
        else:
            start = gamma[:n].sum(0, dtype=np.float64)
    emits = np.stack([np.bincount(symbols, gamma[:, k], minlength=classes) for k in range(states)], axis=1)
    return float(total.sum()), start, moves, emits


def chunks(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, size: int = CHUNK) -> Iterator[tuple[list, list[Counter], list[np.ndarray]]]:
    """(doc_ids, counts of the words of rare classes, class sequences) of documents with `size` tokens together."""
    ids, tails, seqs, held = [], [], [], 0
    h, end = len(vocab.head), len(vocab.head) + RARE
    for b in batches:
        for doc, text in zip(*b.columns[:2], strict=True):
            w = words_of(text.as_py())
            s = np.array([*vocab.encode(w), end], np.int32)
            ids.append(doc.as_py())
            tails.append(Counter(w[i] for i in np.flatnonzero((s >= h) & (s < end)).tolist()))
            seqs.append(s)
            held += len(s)
            if held >= size:
                yield ids, tails, seqs
                ids, tails, seqs, held = [], [], [], 0
    if ids:
        yield ids, tails, seqs


def train(docs: DataFrame, vocab: Vocabulary, states: int = STATES) -> Hmm:
    """docs(doc_id, text): the learning documents."""
    spark = docs.sparkSession
    model = Hmm.initial(vocab, states)
    n = vocab.ends
    if not n:
        return model
    end = len(vocab.head) + RARE
    shared = spark.sparkContext.broadcast(vocab)

    def encoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array([*shared.value.encode(words_of(t.as_py())), end], "<i4").tobytes() for t in b.column(1)], pa.binary())], names=["block", "seq"])

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS)).cast("int")
    made = materialise(docs.select(block.alias("block"), F.col("text").cast("string")).mapInArrow(encoded, "block int, seq binary"), "sequences")
    counts = None
    for k in range(BLOCKS):
        own = gathered(made.filter(F.col("block") == k), model, vocab.classes)
        counts = own if counts is None else [FADE * a + b for a, b in zip(counts, own, strict=True)]
        model = Hmm.from_counts(*counts, vocab)
    for _ in range(FULL):
        model = Hmm.from_counts(*gathered(made, model, vocab.classes), vocab)
    discard(made)
    return model


def gathered(made: DataFrame, model: Hmm, classes: int) -> list[np.ndarray]:
    """made(seq) -> Baum-Welch's expected starts, moves and emissions over all its sequences."""
    states = len(model.start)
    current = made.sparkSession.sparkContext.broadcast(model)

    def gather(batches):
        start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        seqs, held = [], 0

        def add():
            nonlocal start, moves, emits
            _, s, m, e = expected(current.value, seqs, classes)
            start, moves, emits = start + s, moves + m, emits + e

        for b in batches:
            for q in b.column(0):
                seqs.append(np.frombuffer(q.as_py(), "<i4"))
                held += len(seqs[-1])
                if held >= CHUNK:
                    add()
                    seqs, held = [], 0
        if seqs:
            add()
        at = np.flatnonzero(emits.sum(1))
        rows = [-2, *range(-2 - states, -2), *at.tolist()]  # starts, moves, emissions
        values = np.concatenate([start[None], moves, emits[at]])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(values[:, k]) for k in range(states))], names=["at", *(f"s{k}" for k in range(states))])

    cols = [f"s{k}" for k in range(states)]
    # a row per class and task, added up by class: `classes` rows reach the driver
    sums = made.select("seq").mapInArrow(gather, "at int, " + ", ".join(f"{c} double" for c in cols)).groupBy("at").agg(*[F.sum(c).cast("float").alias(c) for c in cols]).toPandas().set_index("at")
    emits = np.zeros((classes, states))
    if -2 not in sums.index:  # no rows, so no task gathered any
        return [np.zeros(states), np.zeros((states, states)), emits]
    own = sums[sums.index >= 0]
    emits[own.index.to_numpy()] = own.to_numpy()
    return [sums.loc[-2].to_numpy(np.float64), sums.loc[[*range(-2 - states, -2)]].to_numpy(np.float64), emits]


def score(docs: DataFrame, model: Hmm, vocab: Vocabulary, counts: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    shared, fitted = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(model)
    total = vocab.tokens + vocab.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value, fitted.value
        part, index, h = TaskContext.get().partitionId() << 36, 0, len(v.head)
        # log10 of c + 1 for the classes of one word; of the class's n + v + 1 for the rest
        own = np.concatenate([np.log10(v.head_counts + 1.0), np.zeros(RARE), [math.log10(v.ends + 1)]])
        within = np.concatenate([np.zeros(h), np.log10(v.rare_tokens + v.rare_words + 1.0), [0.0]])
        for ids, tails, seqs in chunks(batches, v):
            lls = forward(m, seqs)
            for at in range(0, len(ids), 500):
                out = []
                for doc, tail, s, ll in zip(ids[at : at + 500], tails[at : at + 500], seqs[at : at + 500], lls[at : at + 500], strict=True):
                    rare = (s >= h) & (s < h + RARE)
                    out.append((part + index, doc, len(s), int((~rare).sum()) - (v.ends == 0), float(own[s].sum()), ll / math.log(10) - float(within[s].sum()), list(tail), list(tail.values())))
                    index += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "n_tokens", "head_known", "head_sum", "model", "tail", "tf"]
    types = [pa.int64(), pa.int64() if kind == "bigint" else None, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
    part = materialise(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"uid long, doc_id {kind}, n_tokens long, head_known long, head_sum double, model double, tail array<binary>, tf array<int>"), "hmm")
    tails = part.select("uid", F.explode(F.arrays_zip("tail", "tf")).alias("t")).select("uid", F.col("t.tail").alias("word"), F.col("t.tf").alias("tf"))
    found = tails.join(counts, "word").groupBy("uid").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("sum"))
    out = part.drop("tail", "tf").join(found, "uid", "left").na.fill(0, ["known", "sum"])
    return out.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.col("known")).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("sum") - F.col("n_tokens") * F.lit(math.log10(total))).alias("base_score"),
        (F.col("model") + F.col("sum")).alias("score"),
    )


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_column(F.col("doc_id"), 7) == 2
    learn = docs.filter(~held_out)
    counts = materialise(count_words(learn), "words")
    vocab = vocabulary(counts, learn.count())
    out = score(docs, train(learn, vocab), vocab, counts)
    out = out.withColumn("held_out", held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
