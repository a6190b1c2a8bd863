"""Small fixtures with null, empty, tied, repeated and long rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ampline.llm import exact_dedup, fingerprints, graph, hmm, language, line_dedup, mixing, packing, quality, repeats, simhash
from ampline.llm.common import shared_dir, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size int"


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(n))


A, B = sentence(1, 120), sentence(2, 150)
TEXTS = [
    (1, A, "en", "s"), (2, A.replace(" ", "\n ", 3), "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, " \t\n", "fr", "t"), (6, "Ärger über Öl " * 30, "de", "t"),
    (7, B + "\n" + A, "fr", "t"), (8, B[: len(B) // 2] + "X" + B[len(B) // 2 :], "fr", None), (9, sentence(3, 20_000), "de", "hot"), (9, sentence(3, 20_000), "de", "hot"), (10, "one two three", "en", "hot"), (None, "one  two three", "en", "hot"),
    (11, "1 2 3 !!", None, "hot"), (12, "the quick brown fox jumps\nthe quick brown fox leaps\nthe quick brown fox", "en", "u"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, len(t[1]) if t[1] else None, "clash", 7) for t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_exact_dedup_and_index(spark, docs, empty):
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index-test", 4)
    assert exact_dedup.deduplicate(empty, index).count() == 0
    rows = exact_dedup.deduplicate(docs, index).collect()
    norm = {}
    for i, t, *_ in TEXTS:
        norm.setdefault(re.sub("[ \t-\r]+", " ", t or ""), []).append(i)
    want = sorted(((i, min(x for x in ids if x is not None), len(ids)) for ids in norm.values() for i in ids), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows), key=repr) == want
    again = exact_dedup.deduplicate(docs.withColumn("doc_id", F.col("doc_id") + 100), exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index-test", 4)).collect()
    assert not any(r["kept"] for r in again) and index.read().count() == len(norm)


def test_fingerprints(docs, empty):
    assert fingerprints.fingerprint_edits(empty).count() == 0
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    ordered = sorted({(i, t or "") for i, t, *_ in TEXTS if i is not None})
    texts = dict(ordered)
    for k, (i, t) in enumerate(ordered):
        if i in (9, 12):  # repeated rows follow each other; the last is followed by the null id
            continue
        nxt = ordered[k + 1][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[3]["fingerprint"] == "" and rows[3]["near_next"] == 1.0 and len(texts) == 12
    assert all(0 <= r["near_edited"] <= 1 for r in rows.values())


def test_simhash_components(docs, empty):
    def brute(t):
        w = words_of(t)
        k = min(4, len(w))
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    for i, t, *_ in TEXTS[:9]:
        assert simhash.simhash(t) & (1 << 64) - 1 == brute(t), i
    assert simhash.fingerprints(empty, "doc_id").count() == 0
    values = [int(v) for v in np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 300)]
    values += [v ^ (1 << k) ^ (1 << (k + 9)) for k, v in enumerate(values[:40])] + [v ^ 0b11111 for v in values[:20]]
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in values:
        for b in values:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                up[max(find(a), find(b))] = min(find(a), find(b))
    fps = docs.sparkSession.createDataFrame([(v,) for v in values], "fp long")
    for tree in (4096, 7):  # also with shards of many trees
        label = {r["node"]: r["label"] for r in graph.components(simhash.links(fps, tree=tree)).collect()}
        assert all(label.get(v, v) == find(v) for v in values)


def test_line_dedup(docs, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out[12] == "the quick brown fox jumps\nthe quick brown fox"  # one word replaced; the short line stays
    assert out[1] == A and out[3] is None and out[7] == B and out[10] == ""  # null ids come first
    assert [f.name for f in line_dedup.dedup_lines(docs).schema] == docs.columns


def test_repeats(docs, empty):
    assert repeats.removals(empty).count() == 0
    bodies = [(i, (t or "").encode()) for i, t, *_ in TEXTS]
    seen = Counter(b[p : p + 400] for _, b in bodies for p in range(len(b) - 399))
    want = []
    for i, b in bodies:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                mask[p : p + 400] = True
        want.append((i, len(b), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    assert got(repeats.removals(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    assert packing.pack(empty).count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in TEXTS}
    places = set()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        places |= {(r["sequence_id"], r["offset"] + k) for k in range(r["length"])}
    total = sum(len(ids[i]) for i, *_ in TEXTS)
    assert len(places) == total == sum(r["length"] for r in rows)
    used = Counter(s for s, _ in places)
    assert all((s, k) in places for s, n in used.items() for k in range(n)) and sum(1024 - n for n in used.values()) < 1024


def test_histogram_packing_is_complete():
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.random.default_rng(1).integers(1, 1025, 5000), return_counts=True))}
    patterns = packing.pack_histogram(counts)
    placed = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 1024
        for x in lengths:
            placed[x] += n
    assert placed == Counter(counts)


def test_mixing(docs, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(docs).collect()
    assert got(mixing.mix(docs), "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in rows), key=repr)
    assert len(rows) == len(TEXTS) and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[5] == 0
    total = sum(len(words_of(t)) for _, t, *_ in TEXTS)
    assert abs(sum({(r["source"]): r["target"] for r in rows}.values()) - total) < 1e-6 * total


def test_mixing_comes_near_its_targets(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (1 + (i * 37) % 400)), f"s{i % 3}" if i % 2 else "s0") for i in range(3000)], "doc_id long, text string, source string")
    per = {}
    for r in mixing.mix(df).collect():
        per.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t / want - 1) < 0.01 for want, t in per.values())


def test_language(docs, empty):
    model = language.train(docs)
    rows = language.predict(docs, model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows}[11] == "und" and {r["doc_id"]: r["lang_pred"] for r in rows}[3] == "und"
    assert sum(r["lang_pred"] == r["lang"] for r in rows if r["lang"] and r["text"] and len(r["text"]) > 50) >= 6
    none = language.train(empty)
    assert language.predict(docs, none).filter("lang_pred <> 'und'").count() == 0 and language.predict(empty, model).count() == 0
    long = "añb" * 200_000
    whole, at = language.counts(long), language.PIECE
    language.PIECE = 1 << 30
    assert (language.counts(long) == whole).all()
    language.PIECE = at


def test_quality(spark, docs, empty):
    at, x = quality.features("Some words, some MORE words.\nAgain", 30)
    m = quality.Machine()
    v = m.v[at].astype(float) * x[:, None]
    pairs = sum(float(v[i] @ v[j]) for i in range(len(at)) for j in range(i))
    assert abs(m.raw(at, x) - pairs) < 1e-5  # the linear-time identity
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(13)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    rows = quality.score(docs.withColumn("held_out", F.lit(False)), machine).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.train(docs, labels.limit(0)) is None and quality.score(empty.withColumn("held_out", F.lit(False)), machine).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T.astype(np.float32))
    seqs = [rng.integers(0, 5, n) for n in (1, 6, 3)]
    for s, ll in zip(seqs, hmm.forward(model, seqs), strict=True):
        a = model.start * model.emit[s[0]]
        for k in s[1:]:
            a = (a @ model.move) * model.emit[k]
        assert abs(np.log(a.sum()) - ll) < 1e-4
    _, start, moves, emits = hmm.expected(model, seqs, 5)
    assert abs(start.sum() - 3) < 1e-4 and abs(moves.sum() - 7) < 1e-3 and abs(emits.sum() - 10) < 1e-3


def test_hmm_counts(docs, empty):
    learn = docs.filter("doc_id is not null")
    counts = hmm.materialise(hmm.count_words(learn), "words-test")
    vocab = hmm.vocabulary(counts, learn.count(), head=50)
    model = hmm.train(learn, vocab)
    rows = hmm.score(docs, model, vocab, counts).collect()
    c = Counter(w for i, t, *_ in TEXTS if i is not None for w in [*words_of(t), None])
    n, v = sum(c.values()), len(c)
    for r, base in ((r, {i: t for i, t, *_ in TEXTS}[r["doc_id"]]) for r in rows):
        own = [*words_of(base), None]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(c[w] > 0 for w in own) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    assert hmm.score(empty, model, vocab, counts).count() == 0 and len(rows) == len(TEXTS)
