import random

import numpy as np
import pytest
import xxhash

from ridgeline.llm import simhash


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    s = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, most=4):
    fp = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = ["Ab", "the", "çé", "zoo x"] + [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 9, 200, 700]))] for _ in range(30)]
    texts = [" ".join(x) for x in base]
    for x in base:
        for _ in range(4):
            y = list(x)
            for _ in range(r.randrange(4)):
                if y:
                    y[r.randrange(len(y))] = r.choice(vocab)
            texts.append(r.choice([" ", "\n", "\t  "]).join(y))
    texts += [None, "", " \n", "\x1c", "A", "a"]
    ids = r.sample(range(10000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("dense", [65536, 1])
def test_matches_brute_force(spark, dense):
    rows = corpus(dense)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, simhash.cluster(df, dense=dense).collect())) == brute(rows)


def test_golay_keys_meet():
    r = np.random.default_rng(5)
    x = r.integers(0, 2**63, 400, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)
    kx, ix = simhash.keys_of(x)
    ky, iy = simhash.keys_of(y)
    for i in range(400):
        assert set(kx[ix == i]) & set(ky[iy == i])
    assert len(kx) / 400 < 34


def test_breadth_first_forest():
    r = np.random.default_rng(6)
    x = r.integers(0, 1 << 14, 300, dtype=np.uint64)
    a, b = simhash.spread_out({"fp": x}, np.arange(300), simhash.Rule(most=1))
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 1)
    assert (simhash.forest(300, a, b) == simhash.forest(300, near[:, 0], near[:, 1])).all()


def plain_groups(rows, size=2, tables=6, most=4, proof_size=4, verify=12):
    """Components of rows by the pair rule, from fingerprints of each row alone."""
    fps = []
    for t in rows:
        buf = np.frombuffer((t or "").encode(), np.uint8)
        offs = np.array([0, len(buf)])
        fps.append((simhash.fingerprints(buf, offs, size, tables)[0].tolist(), int(simhash.fingerprints(buf, offs, proof_size)[0, 0])))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any((a ^ b).bit_count() <= most for a, b in zip(fps[i][0], fps[j][0])) and (fps[i][1] ^ fps[j][1]).bit_count() <= verify:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("dense", [65536, 1])
def test_dedup_matches_brute_force(spark, dense):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = plain_groups([t for _, t in rows])
    heads = {min(d for (d, _), h in zip(rows, groups) if h == g) for g in set(groups)}
    assert sorted(r.doc_id for r in simhash.dedup(df, dense=dense).collect()) == sorted(heads)
    assert len(heads) < len(rows) - 30


def test_dedup_decides_rows_not_ids(spark):
    a, b = "a b c d e f g h", "quite another text with words of its own here"
    df = spark.createDataFrame([(1, a, 1), (5, a.upper(), 2), (5, b, 3), (9, "z", 4)], "doc_id long, text string, n long")
    assert sorted(r.n for r in simhash.dedup(df).collect()) == [1, 3, 4]
    df = spark.createDataFrame([(3, "a b c d e f", 1, 0), (1, "A b c d e f", 2, 0), (None, "a b c d e f", 3, 0), (None, "q", 4, 0), (9, None, 5, 0), (9, None, 5, 0)], "doc_id long, text string, f0 long, Row long")
    out = simhash.dedup(df)
    assert out.columns == df.columns and sorted(r.f0 for r in out.collect()) == [2, 4, 5]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.cluster(empty).collect() == [] and simhash.dedup(empty).collect() == []


def near_copies(seed, n=150):
    """Texts and copies with edits; only pairs whose 5-word shingles have a Jaccard index of 0.8 or more."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    shingle = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    pairs = []
    while len(pairs) < n:
        x = [r.choice(vocab) for _ in range(r.randrange(80, 600))]
        y = list(x)
        for _ in range(r.randrange(1, 1 + len(x) // 40)):
            y[r.randrange(len(y))] = r.choice(vocab)
        a, b = shingle(x), shingle(y)
        if x != y and len(a & b) / len(a | b) >= 0.8:
            pairs.append((" ".join(x), " ".join(y)))
    return pairs


def test_recall_of_near_copies(spark):
    pairs = near_copies(11)
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(len(pairs)))
    assert sum(2 * k + 1 not in kept for k in range(len(pairs))) >= 0.9 * len(pairs)
