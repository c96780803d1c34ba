"""Mixing sources to target weights by Pareto order sampling (Rosen 1997).

Sources, by code point and null last, weigh 3, 1, 2, repeating, and share ``share`` times all words; a
target stops at ``cap`` times its source's words and the excess is reshared by weight.  Within a
source a document is expected min(cap, c w) times, where w = 8 + floor(log2(size)) lets longer
documents in more often and c meets the target.  Whole copies are taken first.  The rest is the
inclusion probability p of one more copy: documents are ranked by the random odds u/(1-u) divided
by the inclusion odds p/(1-p), and taken from the lowest on until the source's words are met to
within half a document.

u comes from the MD5 of doc_id and size, so reruns agree; rows that share both are taken together.
The rank is cut by a histogram of ``bins`` ranges for each source and an exact pass over the one
range that holds the cut, so a source of any size is no task of its own.  Texts are read once and
never shuffled.  Null text has size 0; empty texts and empty tables take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.scratch import Scratch

WEIGHTS, SHARE, CAP, BINS = (3, 1, 2), 1.5, 2.0, 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def class_of(size: Column) -> Column:
    """8 + the number of binary digits of the size, less one."""
    return (F.length(F.bin(size)) + 7).cast("long")


def chance(doc_id: Column, size: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on doc_id, size and seed."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string")).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: a row for each source."""
    one = Window.orderBy(F.col("source").isNull(), "source")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * F.lit(cap))
    rise = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    rest = rise.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level).withColumn("ratio", F.col("most") / F.col("weight"))
    met = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(everything)
    return by.withColumn("level", met).select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight"))).alias("target"))


def plan(sizes: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """source, class, whole, p, need: copies of each class of sizes, and the source's words to sample."""
    by = sizes.filter("size > 0").groupBy("source", class_of(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    by = by.join(goal, by.source.eqNullSafe(goal.source)).select(by.source, "class", "words", "target")
    fall = Window.partitionBy("source").orderBy(F.desc("class"))
    full = fall.rowsBetween(Window.unboundedPreceding, -1)
    rest = fall.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy("source")
    c = (F.col("target") - F.lit(cap) * F.coalesce(F.sum("words").over(full), F.lit(0))) / F.sum(F.col("class") * F.col("words")).over(rest)
    by = by.withColumn("c", c).withColumn("c", F.max_by(F.when(F.col("c") * F.col("class") <= cap, F.col("c")), F.when(F.col("c") * F.col("class") <= cap, F.col("class"))).over(all_))
    by = by.withColumn("times", F.when(F.col("c").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("c") * F.col("class"))))
    by = by.withColumn("whole", F.floor("times")).withColumn("p", F.col("times") - F.col("whole"))
    return by.withColumn("need", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(all_)).select("source", "class", "whole", "p", "need")


def place(sized: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """Adds whole, need and rank (in (0, 1); null: no further copy) to rows with doc_id, source, size."""
    plans = plans.withColumnsRenamed({"source": "of_source", "class": "of_class"})
    out = sized.join(plans, F.col("source").eqNullSafe(F.col("of_source")) & (class_of(F.col("size")) == F.col("of_class")) & (F.col("size") > 0), "left")
    u = chance(F.col("doc_id"), F.col("size"), seed)
    odds = u / (1 - u) / (F.col("p") / (1 - F.col("p")))
    return out.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds))).drop("of_source", "of_class", "p")


def cuts(placed: DataFrame, bins: int = BINS) -> DataFrame:
    """source, cut: the rank up to which documents get a further copy."""
    ranked = placed.filter("rank is not null").select("source", "size", "rank", "need", F.floor(F.col("rank") * bins).alias("bin"))
    up = Window.partitionBy("source").orderBy("bin")
    by = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rank").alias("top"), F.max("need").alias("need"))
    by = by.withColumn("upto", F.sum("words").over(up)).withColumn("before", F.col("upto") - F.col("words"))
    sure = by.filter("upto <= need").groupBy("source").agg(F.max("top").alias("cut"))
    edge = by.filter("upto > need and before <= need").select(F.col("source").alias("s"), F.col("bin").alias("b"), "before")
    inside = ranked.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    # Ties share a rank: they are one step.
    steps = inside.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.max("before").alias("before"), F.max("need").alias("need"))
    steps = steps.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("rank")))
    more = steps.filter(F.col("upto") - F.col("words") / 2 <= F.col("need")).groupBy("source").agg(F.max("rank").alias("cut"))
    return sure.unionByName(more).groupBy("source").agg(F.max("cut").alias("cut"))


class Plan:
    """What the mix of a table takes: small tables by source and class of sizes; Spark broadcasts them while they are small.

    sized: doc_id, source and size of each row, written once.
    """

    def __init__(self, docs: DataFrame, seed: int = 1, weights=WEIGHTS, share: float = SHARE, cap: float = CAP):
        scratch = Scratch(docs.sparkSession)
        self.seed = seed
        self.sized = scratch.keep(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
        self.goal = scratch.keep(targets(self.sized, weights, share, cap))
        self.plans = scratch.keep(plan(self.sized, self.goal, cap))
        self.cut = scratch.keep(cuts(place(self.sized, self.plans, seed)))

    def copies(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size, ...) with source_size, target and copies."""
        cut = self.cut.withColumnRenamed("source", "cut_source")
        goal = self.goal.withColumnRenamed("source", "goal_source")
        taken = place(rows, self.plans, self.seed)
        taken = taken.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left")
        again = F.coalesce((F.col("rank") <= F.col("cut")).cast("long"), F.lit(0))
        return taken.withColumn("copies", F.coalesce("whole", F.lit(0)) + again)


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies."""
    p = Plan(docs, **kw)
    return p.copies(p.sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The table with each row as often as the mix takes it; a row travels as one struct, so that no name can clash."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = Plan(docs, **kw).copies(rows).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The same by plain windows over whole sources.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS weight FROM sized GROUP BY source
), lev AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
    ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src
), met AS (SELECT level FROM lev WHERE level <= most / weight ORDER BY most / weight, source NULLS LAST LIMIT 1
), goal AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM met) IS NULL THEN most ELSE least(most, (SELECT level FROM met) * weight) END AS target FROM lev
), cls AS (
  SELECT s.source, 7 + length(ltrim(bin(s.size), '0')) AS class, sum(s.size)::BIGINT AS words, max(g.target) AS target
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source WHERE s.size > 0 GROUP BY ALL
), cc AS (
  SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(class * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS c0 FROM cls
), c1 AS (SELECT *, max_by(c0, class) FILTER (WHERE c0 * class <= 2.0) OVER (PARTITION BY source) AS c FROM cc
), c2 AS (SELECT *, CASE WHEN c IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, c * class) END AS times FROM c1
), pl AS (SELECT source, class, floor(times) AS whole, times - floor(times) AS p, target - sum(floor(times) * words) OVER (PARTITION BY source) AS need FROM c2
), ranked AS (
  SELECT s.*, pl.whole, pl.p, pl.need, (('0x' || substr(md5('1:' || coalesce(s.doc_id::VARCHAR, 'null') || ':' || s.size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s LEFT JOIN pl ON s.source IS NOT DISTINCT FROM pl.source AND s.size > 0 AND 7 + length(ltrim(bin(s.size), '0')) = pl.class
), r1 AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS odds FROM ranked
), r2 AS (SELECT *, odds / (1 + odds) AS rank FROM r1
), r3 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, rank) AS words FROM r2 WHERE rank IS NOT NULL
), cut AS (SELECT source, max(rank) AS cut FROM r3 WHERE upto - words / 2.0::DOUBLE <= need GROUP BY source)
SELECT r.doc_id, r.size, g.source_size, g.target, (r.size * (coalesce(r.whole, 0) + CASE WHEN r.rank <= c.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r2 r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
"""
