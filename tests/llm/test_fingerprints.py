import hashlib
import random
import re

import pytest

from ridgeline.llm import fingerprints


def grams(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)] + ["ü", "日本", "x\x1cy"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 8, 30, 150, 600]))) for _ in range(120)]
    texts += texts[:10] + ["", None, " \n", "a"]
    ids = sorted(r.sample(range(-50, 3000), len(texts)))
    return list(zip(ids, texts))


def likeness(f, g):
    if set(f) == {"0"} or set(g) == {"0"}:
        return float(f == g)
    m = sum(f[k : k + 2] == g[k : k + 2] for k in range(0, 256, 2)) / 128
    return max(0.0, (m - 1 / 256) / (1 - 1 / 256))


@pytest.mark.parametrize("ranges", [1, 7])
def test_against_brute_force(spark, ranges):
    rows = corpus(ranges)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n long, bins string").repartition(5)
    out = {r.doc_id: r for r in fingerprints.compare(df, ranges).collect()}
    assert len(out) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        j, nxt = rows[(k + 1) % len(rows)]
        t, nxt, r = t or "", nxt or "", out[i]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == pytest.approx(likeness(r.fingerprint, out[j].fingerprint))
        assert r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint))
        errors += [abs(r.near_edited - jaccard(t, edited)), abs(r.near_next - jaccard(t, nxt))]
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.03
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(out[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_edges(spark):
    df = spark.createDataFrame([(None, "b b"), (1, "c d"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    out = sorted((str(r.doc_id), r.n_chars, r.near_next) for r in fingerprints.compare(df).collect())
    assert out == [("1", 3, 0.0), ("1", 3, 0.0), ("1", 3, 1.0), ("None", 0, 0.0), ("None", 3, 0.0)]
    assert fingerprints.compare(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fingerprints.compare(spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert fingerprints.fingerprint(df).columns == ["doc_id", "text", "fingerprint"]


def test_ids_beyond_doubles_and_without_ids(spark):
    r = random.Random(2)
    rows = [((1 << 60) + k, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 60)))) for k in range(150)]
    rows += [(-(1 << 62) + 1, "far away"), ((1 << 62) + 1, "at the end of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rows.sort()
    for ranges, size in ((9, 64 << 20), (3, 100)):
        out = {x.doc_id: x for x in fingerprints.compare(df, ranges, size).collect()}
        assert len(out) == len(rows)
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            cut = len(t) // 4
            assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
            assert out[i].near_next == pytest.approx(likeness(out[i].fingerprint, out[rows[(k + 1) % len(rows)][0]].fingerprint))
    # Rows without an id are dealt by their texts' hashes; each has a next one, and the last leads on to the first id.
    texts = [f"blank {k} " * 5 for k in range(60)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(3, "three of a kind")], "doc_id long, text string")
    out = fingerprints.compare(df, 5, 200).collect()
    edited = [hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest() for t in texts for n in [*texts, "three of a kind"]]
    assert len(out) == 61 and all(x.edited_sha256 in edited for x in out if x.doc_id is None)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2, 3)], "doc_id long, text string, bins int, bins_w int, Bins_ int")
    assert fingerprints.fingerprint(df).columns == [*df.columns, "fingerprint"]
    assert fingerprints.fingerprint(df).first().bins_w == 2
