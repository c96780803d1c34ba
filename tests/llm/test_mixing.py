import duckdb
import pandas as pd
import random

from ridgeline.llm import mixing

KIND = "doc_id long, text string, source string, size int"


def corpus(seed=1):
    r = random.Random(seed)
    rows = [(i, " \n".join("w" * r.randrange(1, 4) for _ in range(int(r.paretovariate(0.9) * 5) % 3000)), r.choice(["b", "a", None, "ä", "Z"] + ["hot"] * 5), 3) for i in range(900)]
    return rows + [(2000, None, "b", 1), (2001, "", "empty", 1), (None, "a b c", "b", 1), (2002, "x\x1cy z", "tiny", 1)]


def test_matches_sql(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, KIND).repartition(4)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "size"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(mixing.SQL).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in mixing.report(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_targets_and_limits(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    out = mixing.report(df).collect()
    assert len(out) == len(rows)
    goal, taken = {}, {}
    for (_, _, source, _), _ in zip(rows, rows):
        taken.setdefault(source, 0)
    source = {(r[0]): r[2] for r in rows}
    biggest = max(r.size for r in out)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        goal[source[r.doc_id]] = r.target
        taken[source[r.doc_id]] += r.taken
    assert abs(sum(goal.values()) - 1.5 * sum(r.size for r in out)) < 1e-6
    for s in goal:
        assert abs(goal[s] - taken[s]) <= biggest / 2 + 1
    assert sorted(map(str, out)) == sorted(map(str, mixing.report(df).collect()))


def test_mix_repeats_rows_and_edges(spark):
    df = spark.createDataFrame(corpus(3), KIND)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words = mixed.select(mixing.size_of(mixed.text).alias("n")).groupBy().sum("n").first()[0]
    total = df.select(mixing.size_of(df.text).alias("n")).groupBy().sum("n").first()[0]
    assert abs(words / total - 1.5) < 0.2
    empty = spark.createDataFrame([], KIND)
    assert mixing.report(empty).collect() == [] and mixing.mix(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, None, 0), (1, "", "a", 0)], KIND)
    assert [r.taken for r in mixing.report(nothing).collect()] == [0, 0]


def test_columns_that_clash(spark):
    names = ["_rank", "_size", "_copies", "_whole", "_need", "_cut", "_target", "_source_size", "rank", "size", "copies", "whole", "need", "cut", "target", "row", "of_source", "Size2"]
    rows = [(k, f"w{k} " * (k % 7 + 1), "ab"[k % 2], *range(len(names))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mix(df)
    assert out.columns == df.columns
    plain = mixing.mix(df.select("doc_id", "text", "source"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in plain.collect())
    assert all(tuple(r[3:]) == tuple(range(len(names))) for r in out.collect())
