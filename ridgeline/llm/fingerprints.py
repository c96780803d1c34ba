"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit values.

The 5-word shingles of a text are hashed once; the top 7 bits of a hash choose one of 128 bins, and a bin
keeps its least hash.  An empty bin borrows from the first non-empty one in a pseudo-random order of
its own (Shrivastava 2017), so equal patterns of empty bins borrow alike.  The low 8 bits of each
bin are stored.  Of two fingerprints, the share m of equal bins has a chance part of 1/256 that is
corrected: likeness = (m - 1/256) / (1 - 1/256), within 0 and 1.

Only DataFrame functions are used.  Words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than 5 words has
one shingle, the whole sequence; one without words has the zero fingerprint, whose likeness to its
own kind is 1 and to others 0.  Null text is empty.

``compare`` also sets each row beside the next by ascending doc_id (null first, equal ones by hash of the text, then by
text; repeated rows follow each other).  Rows are dealt by ranges of doc_id, as many as the bytes ask for, in one
shuffle; the first row of a range also goes to the range before, so that no range waits for another.
Ranges split at approximate quantiles, compared exactly as longs, and evenly within these; rows
without a doc_id are split by the hash.  Extra columns are of no concern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.kernels import fresh

BINS, SIZE = 128, 5
SPACE = r"[\x20\x09-\x0D]+"


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column ``out``: an array of 128 numbers, bin * 256 + low byte, in order; empty without words.

    Each step is a column that the next one names more than once, which keeps Spark from inlining it.
    """
    s = fresh(df, f"{out}_")[0]
    while any(c.lower() in (s + x for x in "whv") for c in df.columns):
        s += "_"
    df = df.withColumn(s + "w", F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)))
    n = F.size(s + "w")
    one = F.when(n > 0, F.array(F.xxhash64(s + "w"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(s + "h", F.sort_array(F.when(n >= SIZE, F.transform(F.sequence(F.lit(1), n - (SIZE - 1)), lambda i: F.xxhash64(F.slice(s + "w", i, SIZE)))).otherwise(one)))
    bin_of = lambda v: F.shiftrightunsigned(v, 57)
    df = df.withColumn(s + "v", F.filter(s + "h", lambda v, i: (i == 0) | (bin_of(v) != bin_of(F.get(F.col(s + "h"), i - 1)))))
    full = F.transform(s + "v", lambda v: (bin_of(v) * 256 + v.bitwiseAND(F.lit(255))).cast("int"))
    empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.transform(s + "v", lambda v: bin_of(v).cast("int")))
    # The least of pseudo-random numbers whose low byte is the donor's.
    lent = F.transform(empty, lambda j: (j * 256 + F.array_min(F.transform(s + "v", lambda v: F.xxhash64(j * BINS + bin_of(v)).bitwiseAND(F.lit(-256)).bitwiseOR(v.bitwiseAND(F.lit(255))))).bitwiseAND(F.lit(255))).cast("int"))
    df = df.withColumn(out, F.when(F.size(s + "v") > 0, F.sort_array(F.concat(full, lent))).otherwise(F.array().cast("array<int>")))
    return df.drop(s + "w", s + "h", s + "v")


def packed(bins: str) -> Column:
    """The low bytes as 256 hex digits."""
    return F.when(F.size(bins) == 0, F.repeat(F.lit("0"), 2 * BINS)).otherwise(F.array_join(F.transform(bins, lambda e: F.lower(F.substring(F.hex(e % 256 + 256), 2, 2))), ""))


def likeness(a: str, b: str) -> Column:
    chance = 1 / 256
    m = F.size(F.array_intersect(a, b)) / F.lit(float(BINS))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (m - F.lit(chance)) / F.lit(1 - chance)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """The table with column fingerprint added (or replaced)."""
    (bins,) = fresh(docs, "bins")
    return with_bins(docs, "text", bins).withColumn("fingerprint", packed(bins)).drop(bins)


def ranged(rows: DataFrame, range_bytes: int, most: int | None = None) -> DataFrame:
    """Adds part, a number that rises with (doc_id, h), nulls first: about range_bytes of texts each."""
    m = most or min(1024, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = F.octet_length("t")
    facts = rows.agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.when(F.col("doc_id").isNotNull(), size)).alias("known"), F.sum(F.when(F.col("doc_id").isNull(), size)).alias("unknown"),
        F.percentile_approx("doc_id", [k / m for k in range(1, m)] or [0.5], 10 * m).alias("cuts"),
    ).first()
    # Doubles only spread rows within a range: rounding keeps their order.
    pieces = max(1, -(-(facts.unknown or 0) // range_bytes))
    spread = lambda share, n: F.greatest(F.lit(0).cast("long"), F.least(F.floor(share * float(n)).cast("long"), F.lit(n - 1).cast("long")))
    blank = F.lit(-pieces).cast("long") + spread(F.col("h").cast("double") / 2.0**64 + 0.5, pieces)
    if facts.low is None:
        return rows.withColumn("part", blank)
    starts = sorted({facts.low, *(c for c in facts.cuts if facts.low < c <= facts.high)})
    k = max(1, -(-(facts.known or 0) // (range_bytes * len(starts))))
    bounds = F.array(*(F.lit(x).cast("long") for x in [*starts, facts.high]))
    steps = F.array(*(F.lit(1 << b) for b in range(len(starts).bit_length() - 1, -1, -1)))
    fits = lambda at: (at < len(starts)) & (F.get(bounds, at) <= F.col("doc_id"))
    rows = rows.withColumn("at", F.aggregate(steps, F.lit(0), lambda s, step: F.when(fits(s + step), s + step).otherwise(s)))
    begin, end = F.get(bounds, F.col("at")).cast("double"), F.get(bounds, F.col("at") + 1).cast("double")
    known = F.col("at").cast("long") * k + spread((F.col("doc_id").cast("double") - begin) / (end - begin + 1), k)
    return rows.withColumn("part", F.when(F.col("doc_id").isNull(), blank).otherwise(known)).drop("at")


def compare(docs: DataFrame, ranges: int | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of characters replaced by the first as many of the next row's.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = ranged(rows, range_bytes, ranges)
    firsts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("least"))
    up = Window.orderBy("part")  # a row a range
    before = F.coalesce(F.lag("part").over(up), F.max("part").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("part").alias("p"), F.col("least.doc_id").alias("d"), F.col("least.h").alias("g"), before.alias("before"))
    ghosts = rows.join(firsts, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    ghosts = ghosts.groupBy("before").agg(F.min("t").alias("t")).select(F.lit(None).cast("long").alias("doc_id"), "t", F.lit(0).cast("long").alias("h"), F.col("before").alias("part"), F.lit(1).alias("ghost"))
    dealt = with_bins(rows.withColumn("ghost", F.lit(0)).unionByName(ghosts), "t", "bins")
    w = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h", "t")
    dealt = dealt.withColumn("next", F.lead("t").over(w)).withColumn("next_bins", F.lead("bins").over(w)).filter("ghost = 0")
    dealt = dealt.withColumn("n", F.char_length("t"))
    cut = F.floor(F.col("n") / 4).cast("int")
    dealt = dealt.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), F.col("n") - cut), F.substring(F.col("next"), F.lit(1), cut)))
    out = with_bins(dealt, "edited", "edited_bins")
    return out.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"), likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"))
