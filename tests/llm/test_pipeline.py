import random
import re

import numpy as np
import public_tokenizers
from test_simhash import plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm import quality


def cut_repeats(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept) if t is not None else None
    return out


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocab = [f"wörd{k}" for k in range(200)]
    shared = " ".join(r.choice(vocab) for _ in range(40))
    rows, labels = [], []
    for i in range(160):
        words = [r.choice(vocab) for _ in range(r.randrange(20, 150))]
        bad = i % 6 == 0
        if bad:
            words = [w + r.choice(["vile", "!!!"]) if r.random() < 0.5 else r.choice(["filth", "vile"]) for w in words]
        t = " ".join(words) + (" " + shared if i % 4 == 1 else "")
        if i % 11 == 10:
            t = rows[i - 3][1]
        rows.append((i, t, "en", r.choice(["a", "b", None]), len(t)))
        labels.append((i, 1, int(i % 6 == 0 and i % 11 != 10)))
    rows += [(900, None, None, "a", 0), (901, "", "en", None, 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    d = str(tmp_path)
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/{k}")
        after = spark.read.parquet(f"{d}/{k}")
        outs.append(after.collect())
        if k < 4:
            assert after.columns == docs.columns
        docs = after
    # 1: the model's decisions, by an own loop over documents.
    model = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    keep = []
    for row in rows:
        buf = np.frombuffer((row[1] or "").encode(), np.uint8)
        if model.scores(buf, np.array([0, len(buf)]))[1][0] >= 0.5:
            keep.append(row)
    assert {tuple(x) for x in outs[0]} == set(keep) and len(outs[0]) == len(keep)
    assert sum(x.doc_id % 6 == 0 and x.doc_id < 160 and x.doc_id % 11 != 10 for x in outs[0]) < 6 and len(keep) > 110
    # 2: one of each group.
    groups = plain_groups([x[1] for x in keep])
    heads = {min(x[0] for x, h in zip(keep, groups) if h == g) for g in set(groups)}
    assert {x.doc_id for x in outs[1]} == heads < {x[0] for x in keep}
    # 3: repeated strings cut.
    want = cut_repeats([(x.doc_id, x.text) for x in outs[1]])
    assert {x.doc_id: x.text for x in outs[2]} == want
    assert all(x.n_chars == len(x.text) for x in outs[2] if x.text is not None)
    # 4: whole copies near 150 percent of all words.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = {}
    for x in outs[3]:
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
        assert x.text == want[x.doc_id]
    assert max(times.values()) <= 2
    assert abs(sum(size(x.text) for x in outs[3]) / sum(map(size, want.values())) - 1.5) < 0.1
    # 5: every token of every copy once.
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {i: len(t.encode(want[i] or "", add_special_tokens=False).ids) + 1 for i in times}
    packed = {}
    for p in outs[4]:
        assert p.doc_tokens == total[p.doc_id]
        packed[p.doc_id] = packed.get(p.doc_id, 0) + p.length
    assert packed == {i: n * total[i] for i, n in times.items()}
    again = corpus_pipeline.run(spark, d)
    assert sorted((p.doc_id, p.length) for p in again.collect()) == sorted((p.doc_id, p.length) for p in outs[4])


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
