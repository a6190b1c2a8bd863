"""Repeated byte strings: the cover, the names and the whole operator against plain Python."""

import hashlib
from collections import Counter

import numpy as np

from ampline.llm import repeats


def brute(bodies, width=400):
    seen = Counter(b[p : p + width] for b in bodies for p in range(len(b) - width + 1))
    out = []
    for b in bodies:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                mask[p : p + width] = True
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((len(b), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), len(kept), sum(c & 0xC0 != 0x80 for c in kept)))
    return out


def rows_of(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


def test_cover_brings_any_two_positions_to_sampled_residues():
    for order in (2, 3, 5, 7, repeats.ORDER):
        at = repeats.difference_cover(order)
        n = order * order + order + 1
        assert len(at) == order + 1 and {(int(a) - int(b)) % n for a in at for b in at} == set(range(n))


def test_names_are_polynomials_modulo_a_prime():
    rng = np.random.default_rng(1)
    b, v, p = rng.integers(0, 256, 900).astype(np.uint8), int(rng.integers(1000, 1 << 60)), repeats.PRIME
    want = [sum(int(x) * pow(v, k, p) for k, x in enumerate(b[i : i + 400])) % p for i in range(501)]
    assert repeats.window_names(b, 400, v).tolist() == want
    at = np.array([0, 7, 500])
    assert repeats.window_names(b, 400, v, at).tolist() == [want[i] for i in at]
    long = np.full(repeats.PIECE + 399, 255, np.uint8)  # the largest sums
    assert len(set(repeats.window_names(long, 400, v).tolist())) == 1
    x = np.array([0, 1, p - 1, p - 2, 1 << 60], np.uint64)
    assert repeats.times(x, x[::-1].copy()).tolist() == [int(a) * int(c) % p for a, c in zip(x, x[::-1], strict=True)]


def test_units_and_ranges():
    runs = [(0, 3, 10), (1, 0, 25), (4, 7, 8)]
    cut = list(repeats.units(runs, 6))
    assert all(sum(z - a for _, a, z in u) == 6 for u in cut[:-1])
    assert [(i, p) for u in cut for i, a, z in u for p in range(a, z)] == [(i, p) for i, a, z in runs for p in range(a, z)]
    got = {p for a, z in repeats.ranges(np.array([5, 200, 900]), 1000) for p in range(a, z)}
    assert got == {p for s in (5, 200, 900) for p in range(max(0, s - repeats.PERIOD + 1), min(s, 600) + 1)}


def test_passages_at_all_shifts_in_many_blocks_and_units(spark, monkeypatch):
    for name, value in (("SHARE", 0.5), ("BUCKET", 700), ("UNIT", 900), ("CHUNK", 4000)):
        monkeypatch.setattr(repeats, name, value)
    rng = np.random.default_rng(3)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    passages = [noise(n) for n in (399, 400, 401, 520, 1500)]
    texts = [noise(int(rng.integers(0, 300))) + passages[k % 5] + noise(int(rng.integers(0, 300))) for k in range(40)]
    texts += ["ß".encode() * 150 + noise(30), "ß".encode() * 500, b"a" * 3000, texts[0], texts[0], b"", noise(399), noise(2000)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert rows_of(repeats.removals(df)) == brute(texts)


def test_texts_built_to_collide_modulo_a_power_of_two(spark):
    """Thue-Morse strings have equal polynomials modulo 2^64 at every odd point."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    texts = [("x" * 10 + a[:500]).encode(), ("y" * 10 + b[:500]).encode(), a.encode(), b.encode()]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    assert rows_of(repeats.removals(df)) == brute(texts)
