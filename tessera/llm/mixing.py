"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150% of all words; a target stops
at twice its source's words, and the excess goes to the others by weight until none is above: one water level over the
sources sorted by their limit per weight.

Rates. Among all rates r of the documents with sum(size * r) = target in each source and r <= 2, the ones of least
relative entropy to 1 are r = min(2, exp(lambda * size / mean size)). The convex dual is solved by Newton's method,
one number a source, over the histogram (source, size, documents), which is all that the sums need. Steps that leave
the bracket are halved. Sums are exact decimals, so that reruns agree whatever the order of the tasks.

Copies. Rates become copies (0, 1, 2) by systematic rounding over the sizes of a source, largest first; what is missing
or too much afterwards is given to the largest sizes that still fit, in a few rounds. The copies of a size are dealt to
hash buckets of its documents (about the square root of the number of documents, so that no group meets in one task),
and in each bucket to the documents by a hash of their id and text.

Defined results: null text has size 0; a document of size 0 has rate 1 and nothing taken; null sources are one source;
a source without words has the target 0; repeated rows are documents of their own; an empty table gives no rows; other
columns are ignored unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, table

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2
#: Relative error of a source's expected words at which Newton's method stops, and the most rounds.
CLOSE, ROUNDS = 1e-9, 60


def _exact(value: Column) -> Column:
    """Sum of doubles as decimals: the same in any order."""
    return F.sum(value.cast("decimal(30,6)")).cast("double")


def targets(hist: DataFrame) -> DataFrame:
    """s (the source's key), source_size, target, mean (words of a document) for hist (s, size, n)."""
    sums = hist.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("s") == "", "s"))
    w = sums.withColumn("place", place).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    w = w.withColumn("limit", F.lit(float(LIMIT)) * F.col("source_size"))
    everywhere = Window.orderBy(F.col("limit") / F.col("w"), "place")
    before, all_of = everywhere.rowsBetween(Window.unboundedPreceding, -1), everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(SHARE) * F.sum("source_size").over(all_of) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.when(F.col("limit") >= level * F.col("w"), level))
    water = F.first("level", ignorenulls=True).over(all_of)
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(F.col("limit"), water * F.col("w")), F.col("limit")))
    return w.select("s", "source_size", target.alias("target"), F.coalesce(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("mean"))


def _rate(lam: Column) -> Column:
    return F.least(F.lit(float(LIMIT)), F.exp(F.least(lam * F.col("size") / F.col("mean"), F.lit(10.0))))


def balance(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """s and its multiplier lam: distributed Newton iterations on the dual, one row a source."""
    full = F.col("target") >= LIMIT * F.col("source_size") * (1 - 1e-12)
    none = F.lit(None).cast("double")
    state = cut(goals.select("s", "target", "mean", F.when(full, 1e9).otherwise(0.0).alias("lam"), none.alias("lo"), none.alias("hi"), full.alias("done")))
    words = hist.filter("size > 0")
    for _ in range(ROUNDS):
        rate = _rate(F.col("lam"))
        sums = words.join(state.filter("NOT done"), "s").groupBy("s").agg(
            _exact(F.col("n") * F.col("size") * rate).alias("g"),
            _exact(F.when(rate < LIMIT, F.col("n") * F.col("size") * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("g") - F.col("target")
        near = F.abs(gap) <= CLOSE * F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, -gap / F.col("slope")).otherwise(F.when(gap > 0, -1.0).otherwise(1.0))
        tried = F.col("lam") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))
        moved = state.join(sums, "s", "left").withColumns({"lo2": lo, "hi2": hi, "tried": tried, "near": near})
        inside = F.coalesce(F.col("tried") > F.col("lo2"), F.lit(True)) & F.coalesce(F.col("tried") < F.col("hi2"), F.lit(True))
        state = cut(moved.select(
            "s", "target", "mean",
            F.when(F.col("done") | F.col("near") | F.col("g").isNull(), F.col("lam")).when(inside, F.col("tried")).otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("lam"),
            F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("done") | F.coalesce("near", F.lit(True))).alias("done"),
        ), state)
        if state.filter("NOT done").isEmpty():
            return state.select("s", "lam")
    raise RuntimeError(f"no balance within {ROUNDS} rounds")


def allot(hist: DataFrame, goals: DataFrame, multipliers: DataFrame, rounds: int = 3) -> DataFrame:
    """hist with k: the copies that all documents of a source and size get together."""
    sized = hist.filter("size > 0").join(goals, "s").join(multipliers, "s").withColumn("want", F.col("n") * _rate(F.col("lam")))
    down = Window.partitionBy("s").orderBy(F.desc("size"))
    upto, before, whole = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("s")
    so_far = F.sum("want").over(upto)
    rounded = sized.withColumn("c", F.floor(so_far + 0.5)).withColumn("k", F.greatest(F.lit(0), F.least(LIMIT * F.col("n"), F.col("c") - F.coalesce(F.lag("c").over(down), F.lit(0)))))
    for _ in range(rounds):
        rounded = rounded.withColumn("rest", F.round(F.col("target")).cast("long") - F.sum(F.col("k") * F.col("size")).over(whole))
        fits = F.col("size") <= F.abs("rest")
        rounded = rounded.withColumn("room", F.when(fits, F.when(F.col("rest") > 0, LIMIT * F.col("n") - F.col("k")).otherwise(F.col("k"))).otherwise(0))
        left = F.abs("rest") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        more = F.least(F.col("room"), F.floor(F.greatest(left, F.lit(0)) / F.col("size")))
        rounded = rounded.withColumn("more", more).withColumn("k", F.col("k") + F.when(F.col("rest") > 0, F.col("more")).otherwise(-F.col("more")))
    return rounded.select("s", "size", "n", F.col("k").cast("long").alias("k"))


def mix(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document; with further columns of documents: doc_id, copies and these."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("s"), size.alias("size"), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(more)))
    if not more:
        docs = cut(docs)
    hist = cut(docs.groupBy("s", "size").agg(F.count("*").alias("n")))
    buckets = max(1, round((hist.agg(F.sum("n")).first()[0] or 0) ** 0.5))
    goals = cut(targets(hist))
    shares = cut(allot(hist, goals, balance(hist, goals)))
    docs = docs.withColumn("b", F.pmod("h", F.lit(buckets)).cast("int"))
    by_bucket = docs.groupBy("s", "size", "b").agg(F.count("*").alias("nb")).join(shares, ["s", "size"])
    along = Window.partitionBy("s", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("nb").over(along)
    extra = lambda c: F.floor((F.col("k") % F.col("n")).cast("decimal(19,0)") * c.cast("decimal(19,0)") / F.col("n").cast("decimal(19,0)")).cast("long")
    by_bucket = by_bucket.withColumn("upto", upto).withColumn("kb", F.expr("k div n") * F.col("nb") + extra(F.col("upto")) - extra(F.col("upto") - F.col("nb")))
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("s", "size", "b").orderBy(F.xxhash64("h", F.lit(1)), "h", "doc_id")))
    dealt = ranked.join(by_bucket.select("s", "size", "b", "nb", "kb"), ["s", "size", "b"], "left").join(goals.select("s", "source_size", "target"), "s")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.expr("kb div nb") + (F.col("rank") <= F.col("kb") % F.col("nb")).cast("int")).cast("int")
    own = [F.col(f"own_{i}").alias(c) for i, c in enumerate(more)]
    dealt = dealt.withColumn("copies", copies)
    if more:
        return dealt.select("doc_id", "copies", *own)
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(documents: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it has copies, with all its columns."""
    others = [c for c in documents.columns if c != "doc_id"]
    mixed = mix(documents, *others)
    return mixed.withColumn("__again", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


SQL = None
