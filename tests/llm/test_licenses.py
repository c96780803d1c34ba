import random

import duckdb
import pandas as pd

from ridgeline.llm import licenses


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["the", "license", "under", "version", "public", "gnu", "é"] + [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        t = " ".join(r.choice(vocab) for _ in range(r.randrange(200)))
        for _ in range(r.randrange(3)):
            lic = r.choice(licenses.TEMPLATES)[2]
            if r.random() < 0.4:
                w = lic.split()
                w[r.randrange(len(w))] = r.choice(vocab)
                lic = " ".join(w)
            if r.random() < 0.3:
                lic = lic.upper().replace(" ", "\n* ")
            a = r.randrange(len(t) + 1)
            t = t[:a] + " " + lic + " " + t[a:]
        rows.append((i, t))
    return rows + [(500, None), (501, ""), (502, "Released under the MIT License"), (None, "x Released under the MIT License."), (503, "released under the mit")]


def test_matches_exact_containment(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n int, template string").repartition(3)
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(licenses.sql()).fetchall()
    got = [tuple(r) for r in licenses.scan(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 60


def test_short_templates_and_empty(spark):
    df = spark.createDataFrame([(1, "see the BSD license here"), (2, "bsd"), (3, "BSD-license")], "doc_id long, text string")
    out = licenses.scan(df, (("b", "BSD", "BSD license"),)).collect()
    assert sorted(r.doc_id for r in out) == [1, 3]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_reach_the_promise():
    assert licenses.bands_for(5, 1, 5, 0.8, 1e-9) == 114


def test_whole_texts_within_long_documents(spark):
    from ridgeline.llm import license_texts

    r = random.Random(4)
    filler = lambda n: " ".join(f"word{r.randrange(5000)}" for _ in range(n))
    edited = license_texts.BSD_3.replace("specific prior written", "prior written").replace("documentation", "papers")
    rows = [(1, filler(333) + " " + license_texts.MIT + " " + filler(250)), (2, filler(41) + "\n" + edited), (3, filler(900)), (4, license_texts.ZLIB[: len(license_texts.ZLIB) // 2] + filler(60))]
    out = {(x.doc_id, x.template): x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1, "mit-text"].containment == 1.0 and out[1, "mit-text"].license == "MIT" and (1, "mit-grant") in out
    assert 0.8 <= out[2, "bsd-3-text"].containment < 1.0
    assert not any(d == 3 for d, _ in out) and (4, "zlib-text") not in out
