import hashlib
import random
import re

import pytest

from ridgeline.llm import debruijn


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def brute(rows, k=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            x = tuple(w[s : s + k])
            if x in seen:
                gone[s : s + k] = [True] * k
            seen.add(x)
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=70):
    r = random.Random(seed)
    vocab = ["the", "ça", "x", "ab\x1cc"] + [f"w{k}" for k in range(25)]
    make = lambda k: [r.choice(vocab) for _ in range(k)]
    common, texts = make(60), []
    for i in range(n):
        t = make(r.randrange(90))
        if i % 3 == 0:
            t += common[r.randrange(35) :] + make(4)
        if i % 4 == 0 and texts:
            s = r.choice(texts)
            a = r.randrange(len(s) + 1)
            t = s[a : a + 60] + t
        if i % 9 == 0 and texts:
            t = r.choice(texts)
        texts.append(t)
    texts = [r.choice([" ", "\n", " \t "]).join(t) for t in texts] + ["", None, "a " * 500, " b" * 19, " b" * 20, " b" * 20, " b" * 21]
    ids = r.sample(range(5000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("hot,block", [(1024, 3000), (2, 3000), (0, 700), (1024, 1 << 20)])
def test_matches_brute_force(spark, hot, block):
    rows = corpus(hot + block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = debruijn.report(df, hot=hot, block_bytes=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows)
    texts = {i: words(t) for i, t in rows}
    for r in out:
        for s in r.spans:
            here = texts[r.doc_id][s.start : s.start + s.words]
            assert here == texts[s.source_doc][s.source_start : s.source_start + s.words] and len(here) == s.words >= 20
            assert (s.source_doc, s.source_start) < (r.doc_id, s.start)


def test_paths_and_edges(spark):
    t = " ".join(f"v{k}" for k in range(50))
    df = spark.createDataFrame([(1, t, 0), (2, "q " + t, 1), (3, t + " z", 2), (None, None, 3), (7, "", 4)], "doc_id long, text string, n long")
    out = debruijn.report(df)
    assert [tuple(r) for r in debruijn.repeated_paths(out).collect()] == [(1, 0, 50, 2)]
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 50, 3: 50, None: 0, 7: 0}
    assert debruijn.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(2048)
    rest = " " + " ".join(f"t{k}" for k in range(19))
    df = spark.createDataFrame([(1, a + rest), (2, b + rest), (3, b + rest)], "doc_id long, text string")
    for hot in (1024, 0):
        for block in (100, 1 << 20):
            out = {r.doc_id: r.n_removed for r in debruijn.report(df, hot=hot, block_bytes=block).collect()}
            assert out == {1: 0, 2: 0, 3: 20}


def test_collisions_are_found_at_the_source(spark):
    rows = corpus(77, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = debruijn.report(df, trust=3, block_bytes=900).collect()  # nearly all windows collide at first
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows)


def test_packs_dealt_twice_and_clashing_columns(spark):
    rows = corpus(5, 40)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block long, packed int").repartition(3)
    out = debruijn.report(df, block_bytes=700, bucket_bytes=300, fan=4).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows)
