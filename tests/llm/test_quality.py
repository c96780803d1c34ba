import random

import numpy as np

from ridgeline.llm import quality


def corpus(seed=1, n=1600):
    r = random.Random(seed)
    vocab = [f"word{k}" for k in range(400)]
    docs, labels, kinds = [], [], {}
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(20, 400))]
        kind = r.choice(["good"] * 6 + ["toxic", "junk"])
        if kind == "toxic":
            for _ in range(max(2, len(words) // 60)):
                words[r.randrange(len(words))] = r.choice(["vile", "awful", "filth"]) + r.choice(["", ",", "###"])
        elif kind == "junk":
            words = [w.upper() + "!!" if r.random() < 0.8 else w for w in words]
        docs.append((i, " ".join(words), "x", i))
        kinds[i] = kind
        labels.append((i, 0 if kind == "junk" else 1, int(kind == "toxic")))
    return docs, labels, kinds


KIND, LABELS = "doc_id long, text string, source string, keep long", "doc_id long, quality int, toxic int"


def test_held_out_selection(spark):
    docs, labels, kinds = corpus()
    df, marks = spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(labels[:1300] + [(None, 1, 0), (5000, 1, 1), (1, None, None)], LABELS)
    model = quality.fit(df, marks)
    out = {r.doc_id: r for r in quality.score(df, model).collect()}
    test = [i for i in kinds if i >= 1300]
    assert np.mean([out[i].keep == (kinds[i] == "good") for i in test]) > 0.93
    grade = {"toxic": 0, "junk": 1, "good": 2}
    assert np.corrcoef([out[i].expected_grade for i in test], [grade[kinds[i]] for i in test])[0, 1] > 0.9
    kept = quality.select(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i].keep}


def test_thresholds_are_ordered_and_fit_is_repeatable():
    docs, labels, kinds = corpus(2, 200)
    rows = []
    for _, text, _, _ in docs:
        buf = np.frombuffer(text.encode(), np.uint8)
        rows.append(quality.features(buf, np.array([0, len(buf)]))[1])
    grades = np.array([{"toxic": 0, "junk": 1, "good": 2}[kinds[i]] for i in range(200)])
    a, b = quality.fit_rows(rows, grades), quality.fit_rows(rows, grades)
    assert a.cuts[0] < a.cuts[1] and (a.weights == b.weights).all()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 1), (None, "x " * 50000, "a", 2), (2, "!!! ###", None, 3)], KIND)
    none = spark.createDataFrame([], LABELS)
    assert [r.keep for r in quality.score(df, quality.fit(df, none)).collect()] == [True] * 4
    docs, labels, _ = corpus(3, 120)
    model = quality.fit(spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, LABELS))
    assert len(quality.score(df, model).collect()) == 4
    assert quality.score(spark.createDataFrame([], KIND), model).collect() == []


def plain_fit(rows, grades, epochs, l1, rate=0.5, l2=1.0, batch=64):
    """The same descent with dictionaries and loops, from the formulas of the cumulative-link model."""
    import math

    sig = lambda v: 1 / (1 + math.exp(max(-50.0, min(50.0, v))))
    z, n, w = {}, {}, {}
    share = [min(0.99, max(0.01, sum(g <= k for g in grades) / len(grades))) for k in (0, 1)]
    cuts = [math.log(s / (1 - s)) for s in share]
    cuts[1] = max(cuts[1], cuts[0] + 0.1)
    pace = [0.0, 0.0]
    r = np.random.default_rng(7)
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for lo in range(0, len(order), batch):
            g, d = {}, [0.0, 0.0]
            for i in order[lo : lo + batch]:
                f = sum(w.get(x, 0.0) for x in rows[i].tolist())
                edge = [-60, *cuts, 60]
                hi, low = sig(f - edge[grades[i] + 1]), sig(f - edge[grades[i]])
                p = max(hi - low, 1e-9)
                for x in rows[i].tolist():
                    g[x] = g.get(x, 0.0) + 1 - hi - low
                if grades[i] < 2:
                    d[grades[i]] -= hi * (1 - hi) / p
                if grades[i] > 0:
                    d[grades[i] - 1] += low * (1 - low) / p
            for x, v in g.items():
                sigma = (math.sqrt(n.get(x, 0.0) + v * v) - math.sqrt(n.get(x, 0.0))) / rate
                z[x] = z.get(x, 0.0) + v - sigma * w.get(x, 0.0)
                n[x] = n.get(x, 0.0) + v * v
                big = abs(z[x]) > l1
                w[x] = -(z[x] - math.copysign(l1, z[x])) / ((0.1 + math.sqrt(n[x])) / rate + l2) if big else 0.0
            for k in (0, 1):
                pace[k] += d[k] ** 2
                cuts[k] -= 0.1 * d[k] / (1 + math.sqrt(pace[k]))
            cuts[1] = max(cuts[1], cuts[0] + 0.1)
    return w, cuts


def test_fit_and_scores_match_plain_loops(spark):
    import math

    docs, labels, kinds = corpus(5, 150)
    df, marks = spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, LABELS)
    rows = []
    for _, text, _, _ in docs:
        buf = np.frombuffer(text.encode(), np.uint8)
        rows.append(quality.features(buf, np.array([0, len(buf)]))[1])
    grades = [{"toxic": 0, "junk": 1, "good": 2}[kinds[i]] for i in range(150)]
    model = quality.fit_rows(rows, np.array(grades), epochs=3, l1=0.2)
    w, cuts = plain_fit(rows, grades, 3, 0.2)
    assert np.allclose(model.cuts, cuts) and {int(k) for k in np.flatnonzero(model.weights)} == {k for k, v in w.items() if v}
    assert all(abs(model.weights[k] - v) < 1e-9 for k, v in w.items())
    out = {r.doc_id: r for r in quality.score(df, quality.fit(df, marks)).collect()}
    model = quality.fit(df, marks)
    for i in range(0, 150, 5):
        f = sum(model.weights[k] for k in rows[i].tolist())
        above = [1 / (1 + math.exp(c - f)) for c in model.cuts]
        assert abs(out[i].expected_grade - sum(above)) < 1e-9 and abs(out[i].tail_probability - above[1]) < 1e-9
        assert out[i].keep == (above[1] >= 0.5)
