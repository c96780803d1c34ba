import random
import zlib

import numpy as np

from ridgeline.llm import langid

EN = "the of and to in is that it was for on are with as be this have from or had by word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei straße schön während können müssen größe".split()
RU = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой человек год от так о для ты же все тот мочь вы".split()


def make(r, words, n):
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def corpus(seed=1):
    r, rows = random.Random(seed), []
    for i in range(240):
        lang, words = r.choice([("en", EN), ("de", DE), ("ru", RU)])
        rows.append((i, make(r, words, r.randrange(5, 120)), lang if r.random() > 0.1 else None, "s", lang))
    return rows


KIND = "doc_id long, text string, lang string, source string"


def test_held_out_accuracy_and_spans(spark):
    rows = corpus()
    r = random.Random(9)
    first, second = make(r, EN, 40), make(r, DE, 30)
    extra = [(900, first + "\n" + second, None), (901, None, "en"), (902, "", None), (903, "12 34 ,. — …", "de"), (904, "中文 字", None), (None, make(r, EN, 30), "en"), (905, " \n ", None)]
    df = spark.createDataFrame([x[:4] for x in rows] + [(a, b, c, "s") for a, b, c in extra], KIND).repartition(3)
    out = {x.doc_id: x for x in langid.evaluate(df).collect()}
    assert len(out) == len(rows) + len(extra)
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert all(out[x[0]].held_out == (x in held) for x in rows)
    assert np.mean([out[x[0]].lang_pred == x[4] for x in held]) > 0.97
    for i in (901, 902, 903, 905):
        assert (out[i].lang_pred, out[i].score, out[i].spans) == ("und", 0.0, [])
    assert out[904].lang_pred in ("en", "de", "ru") and out[None].lang_pred == "en" and out[None].held_out is False
    spans = out[900].spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[1].start - len(first.encode())) < 25
    assert out[900].score < 0.9


def test_lang_and_id_are_not_inputs(spark):
    rows = [x[:4] for x in corpus(2)]
    a = {r.doc_id: r.lang_pred for r in langid.evaluate(spark.createDataFrame(rows, KIND)).collect()}
    twisted = [(i, t, l if zlib.crc32(str(i).encode()) % 3 != 1 else "xx", "q") for i, t, l, _ in rows]
    b = {r.doc_id: r.lang_pred for r in langid.evaluate(spark.createDataFrame(twisted, KIND)).collect()}
    assert a == b


def test_empty_and_unlabelled(spark):
    assert langid.evaluate(spark.createDataFrame([], KIND)).collect() == []
    out = langid.evaluate(spark.createDataFrame([(1, "some text", None, None)], KIND)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_viterbi_against_brute_force():
    r = np.random.default_rng(4)
    from itertools import product

    first = np.array([0, 5, 5, 11, 12])
    s = r.normal(size=(12, 3)).astype(np.float32)
    got = langid.viterbi(s, first, 0.7)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            value = lambda p: sum(s[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
            best = max(product(range(3), repeat=b - a), key=value)
            assert abs(value(best) - value(got[a:b])) < 1e-4


def test_two_languages_of_an_unlisted_script(spark):
    r = random.Random(5)
    base = [chr(0x0C15 + k) for k in range(30)]  # letters of Telugu, which no range lists
    far = [chr(0x10380 + k) for k in range(20)]  # and of a script beyond two bytes
    words = [["".join(r.choice(base[a : a + 18]) for _ in range(r.randrange(2, 7))) for _ in range(60)] for a in (0, 12)]
    words.append(["".join(r.choice(far) for _ in range(4)) for _ in range(40)])
    rows = []
    for i in range(180):
        k = i % 3
        rows.append((i, " ".join(r.choice(words[k]) for _ in range(r.randrange(8, 60))), ["te", "xa", "ug"][k], "s"))
    rows += [(1000 + i, make(r, EN, 30), "en", "s") for i in range(60)]
    out = {x.doc_id: x for x in langid.evaluate(spark.createDataFrame(rows, KIND)).collect()}
    held = [x for x in rows if out[x[0]].held_out]
    assert len(held) > 50 and np.mean([out[x[0]].lang_pred == x[2] for x in held]) > 0.95
    assert all(out[x[0]].score > 0 for x in held)


def test_scripts_of_letters():
    for c, name in (("a", "Latin"), ("é", "Latin"), ("ж", "Cyrillic"), ("త", "Other"), ("ሀ", "Other"), ("𐎀", "Other"), ("漢", "Han"), ("5", ""), ("×", ""), ("…", ""), ("😀", "")):
        buf = np.frombuffer(c.encode(), np.uint8)
        code, size = langid.script_bytes(buf)
        assert langid.SCRIPTS[code[0]] == name and size[0] == (len(buf) if name else 0)


def plain_model(rows):
    """Counts of hashed 4-grams and of first letters' scripts by language, a word at a time."""
    grams, scripts = {}, {}
    for _, text, lang, _ in rows:
        for w in features(text):
            for f in w[0]:
                if w[1]:
                    grams.setdefault(lang, {}).setdefault(f, 0)
                    grams[lang][f] += 1
            scripts.setdefault(lang, {}).setdefault(w[1], 0)
            scripts[lang][w[1]] += 1
    return grams, scripts


def features(text):
    out = []
    words = text.lower().encode().split()  # texts of these tests have plain spaces only
    flat = b" " + b"".join(w + b" " for w in words) + b"  "
    at = 0
    for w in words:
        own = []
        for k in range(at, at + len(w) + 1):
            g = int.from_bytes(flat[k : k + 4], "little")
            g = ((g ^ (g >> 15)) * 0x9E3779B1) & 0xFFFFFFFF
            own.append(g >> 16)
        at += len(w) + 1
        letters = [c for c in w.decode() if c.isalpha()]
        script = langid.script_of(np.array([ord(letters[0])]))[0] if letters else 0
        out.append((own, int(script), sum(len(c.encode()) for c in letters)))
    return out


def test_predictions_match_a_plain_scorer(spark):
    import math

    rows = [x[:4] for x in corpus(7) if x[2]]
    docs = spark.createDataFrame(rows, KIND)
    train = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    grams, scripts = plain_model(train)
    langs = sorted(scripts)
    logs = {l: (lambda f, own=grams[l], n=sum(grams[l].values()): math.log((own.get(f, 0) + 0.5) / (n + 0.5 * 65536))) for l in langs}
    allowed = {l: {s for s, n in scripts[l].items() if n / sum(scripts[l].values()) >= 0.001} | {0} for l in langs}
    got = {x.doc_id: x for x in langid.evaluate(docs).collect()}
    for i, text, _, _ in rows[::7]:
        words = features(text)
        best = {l: (0.0, ()) for l in langs}
        for n, (own, script, _) in enumerate(words):
            fits = [l for l in langs if script in allowed[l]] or langs
            score = {l: sum(map(logs[l], own)) / len(own) ** 0.5 if l in fits else -1e4 for l in langs}
            top = max(score.values())
            score = {l: score[l] - top if script else 0.0 for l in langs}
            step = {}
            for l in langs:
                came = max(langs, key=lambda m: best[m][0] - (langid.PENALTY if m != l and n else 0))
                step[l] = (best[came][0] - (langid.PENALTY if came != l and n else 0) + score[l], best[came][1] + (l,)) if n else (score[l], (l,))
            best = step
        path = max(best.values())[1]
        share = {l: sum(w[2] for w, p in zip(words, path) if p == l) for l in langs}
        assert got[i].lang_pred == max(langs, key=lambda l: share[l])
        assert abs(got[i].score - max(share.values()) / sum(share.values())) < 1e-9


def test_repeated_rows_and_long_texts(spark):
    r = random.Random(3)
    rows = [x[:4] for x in corpus(4)] + [(7000, " ".join(r.choice(DE) for _ in range(200_000)), "de", "s")] * 2
    out = [x for x in langid.evaluate(spark.createDataFrame(rows, KIND)).collect() if x.doc_id == 7000]
    assert len(out) == 2 and {x.lang_pred for x in out} == {"de"}
