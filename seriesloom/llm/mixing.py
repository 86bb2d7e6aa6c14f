"""op5: mixing sources to target sizes by Pareto order sampling.

A document's size is its number of words. Sources, in code-point order with
null last, weigh 5, 2, 1, repeating; they share `share` times all sizes,
but none gets over `most` times its own size: what is over is shared by
weight among the others until none is above.

Chances are unequal: within a source the expected copies of a document are in
proportion to the `power` of its size (a fourth root, so that long documents
come oftener than short ones), `most` at most, and so that the expected words
are the target. Every document gets the whole copies that are certain, the
whole part of its expected copies. What is left, under 1, is its inclusion
chance; documents are ranked by their random odds divided by their inclusion
odds and taken in that order.
A document that would pass the target is passed over and those behind it are
still tried, until none is small enough. One more document, the one whose
size comes nearest to the shortage, is added if that brings the source nearer.

Ranks are cut in two steps, so that a source with a third of all rows is
never sorted in one task: sums of rank buckets, then the order inside a
bucket. Buckets are slices of the logarithm of the ranking ratio, and get
finer with the number of rows, so that a bucket holds about IN_BUCKET rows at
most. A pass takes documents up to the first that does not fit; the next
looks behind it, at documents no larger than what is left, so what is left
falls below the size of each document passed over. Rows that repeat source,
id and size are counted as one group.
Random numbers are hashes of the id, so that reruns agree. Only SQL
functions are used.

Defined results: a null text has size 0 and is taken 0 times, as is every
row of a source without words. Null ids and sources take part; equal rows
are interchangeable. Ties of the order go to the smaller random number, then
to the smaller id. Of a text, of any length, only its number of words is kept. An empty table gives an empty result; extra columns
are ignored, except by `mixed_rows`, which keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import boxed, discard, documents, store, unboxed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, POWER, IN_BUCKET, SEED = (5, 2, 1), 1.5, 2, 0.25, 1 << 16, 17
KEY = ("source", "id", "size")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from source and source_size."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1).cast("double"))
    every = Window.partitionBy()
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    return (
        weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("left", share * F.sum("source_size").over(every) - F.sum("cap").over(rise) + F.col("cap"))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.sum("weight").over(rise) + F.col("weight")))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))
    )


def expected_copies(groups: DataFrame, goal: DataFrame, most: float = MOST, power: float = POWER) -> DataFrame:
    """`goal` with `unit` and `rest` of each source: a document's expected copies are the least of `most` and unit * size ** power; `rest` are the words that certain copies leave.

    Sizes whose share would pass `most`, the longest first, get `most` each and the others share what is left."""
    sizes = groups.where("size > 0").groupBy("source", "size").agg(F.sum("rows").alias("rows"))
    table = sizes.join(goal.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.col("rows") * F.col("size")
    shares = whole * F.pow("size", F.lit(power))
    longer = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("target") - float(most) * F.coalesce(F.sum(whole).over(longer), F.lit(0))
    level = table.withColumn("unit", left / F.sum(shares).over(shorter))
    open_ = F.when(F.col("unit") * F.pow("size", F.lit(power)) < float(most), F.col("size"))
    # Sizes up to the longest that stays below `most` have its unit; where none does, all have `most`.
    units = level.groupBy("source").agg(F.max_by("unit", open_).alias("unit"))
    units = store(units.select(F.col("source").alias("s"), F.when(F.col("unit").isNull(), float("inf")).otherwise(F.greatest("unit", F.lit(0.0))).alias("unit")), "op5-units")
    sure = table.join(units, F.col("source").eqNullSafe(F.col("s"))).groupBy(F.col("source").alias("s2")).agg(F.sum(F.floor(_copies(most, power)) * whole).alias("sure"))
    out = goal.join(units, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(sure, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    return out.withColumn("unit", F.coalesce("unit", F.lit(0.0))).withColumn("rest", F.col("target") - F.coalesce("sure", F.lit(0)))


def _copies(most: float, power: float) -> Column:
    return F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("unit") * F.pow("size", F.lit(power)))).otherwise(0.0)


def _before() -> Column:
    return F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")


def _passes(taken: DataFrame, short: DataFrame) -> DataFrame | None:
    """source, id, size, add: what later passes take behind the first document that did not fit. `short` has what is left of each source."""
    order = ("bucket", "odds", "u", "id", "size")
    left = taken.where("more < rows and size > 0 and chance > 0").select(*KEY, (F.col("rows") - F.col("more")).alias("rows"), "bucket", "odds", "u")
    found, words = None, F.col("rows") * F.col("size")
    # No document behind the first that did not fit was taken, and none before it is small enough.
    while True:
        goal = short.select(F.col("source").alias("s"), "short")
        left = left.join(goal, F.col("source").eqNullSafe(F.col("s"))).where(F.col("size") <= F.col("short")).drop("s")
        sums = left.groupBy("source", "bucket").agg(F.sum(words).alias("words"), F.max("short").alias("short")).withColumn("before", _before())
        sums = store(sums.where(F.col("before") < F.col("short")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before"), "op5-pass-buckets")
        if sums.isEmpty():
            return found
        near = left.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        start = F.col("before") + F.sum(words).over(Window.partitionBy("source", "bucket").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)) - words
        add = F.greatest(F.lit(0), F.least("rows", F.floor((F.col("short") - start) / F.col("size")))).cast("long")
        now = store(near.withColumn("add", add).where("add > 0").select(*KEY, "add"), "op5-pass")
        found = now if found is None else store(found.unionByName(now).groupBy(*KEY).agg(F.sum("add").alias("add")), "op5-passed")
        went = now.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("add") * F.col("size")).alias("went"))
        short = store(short.join(went, F.col("source").eqNullSafe(F.col("s"))).select("source", (F.col("short") - F.col("went")).alias("short")), "op5-short")
        gone = now.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"), "add")
        hit = F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z"))
        left = left.drop("short").join(gone, hit, "left").withColumn("rows", F.col("rows") - F.coalesce("add", F.lit(0))).where("rows > 0").drop("s", "i", "z", "add")
        left = store(left, "op5-left")


def drawn_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, power: float = POWER, **rules) -> tuple[DataFrame, DataFrame]:
    """(groups, goals): groups of equal (source, id, size) with rows (how many), whole, chance, their random number u and the logarithm `ratio` of random odds over inclusion odds; and a row a source."""
    most = rules.get("most", MOST)
    sized = df.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"))
    groups = store(sized.groupBy(*KEY).agg(F.count("*").alias("rows")), "op5-groups")
    words = F.col("rows") * F.col("size")
    goal = targets(groups.groupBy("source").agg(F.sum(words).alias("source_size")), **rules)
    goal = store(expected_copies(groups, store(goal, "op5-goals"), most, power), "op5-targets")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    each = groups.join(goal.select(F.col("source").alias("s"), "source_size", "target", "unit", "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = each.withColumn("copies", _copies(most, power)).withColumn("whole", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("whole")).withColumn("u", uniform)
    ratio = F.when(F.col("chance") > 0, F.ln(F.col("u") / (1 - F.col("u"))) - F.ln(F.col("chance") / (1 - F.col("chance"))))  # a chance is under 1
    return each.withColumn("ratio", ratio).drop("copies", "unit"), goal


def sampled_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Groups of equal (source, id, size): rows (how many), source_size, target, whole (copies of every row), more (rows with one copy more)."""
    most = options.get("most", MOST)
    each, goal = drawn_groups(df, id_col, text_col, source_col, **options)
    drawn = store(each, "op5-drawn")
    fine = max(64, drawn.count() // (4 * IN_BUCKET))  # slices of one unit of the logarithm; no such slice has over a quarter of its odds' rows
    settled = -F.pmod(F.xxhash64("id", "size"), F.lit(4096)) - (1 << 40)  # what certain copies settle is in no slice, and dealt by its hash
    drawn = drawn.withColumn("bucket", F.coalesce(F.floor(F.col("ratio") * fine), settled)).withColumnRenamed("ratio", "odds")
    words = F.col("rows") * F.col("size")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    by_bucket = drawn.where("chance > 0").groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    by_bucket = store(by_bucket.withColumn("before", _before()).drop("words"), "op5-buckets")
    ranked = drawn.join(by_bucket, same(drawn, by_bucket) & (drawn.bucket == by_bucket.bucket), "left").drop(by_bucket.source).drop(by_bucket.bucket)
    order = Window.partitionBy("source", "bucket").orderBy("odds", "u", "id", "size")
    start = F.col("before") + F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0)) - words
    fit = F.greatest(F.lit(0), F.least("rows", F.floor(F.try_divide(F.col("rest") - start, "size"))))
    taken = store(ranked.withColumn("more", F.coalesce(F.when(F.col("chance") > 0, fit), F.lit(0)).cast("long")).select(*KEY, "rows", "source_size", "target", "whole", "rest", "bucket", "odds", "u", "chance", "more"), "op5-ranked")
    discard(drawn, by_bucket)
    short = store(taken.groupBy("source").agg((F.max("rest") - F.sum(F.col("more") * F.col("size"))).alias("short")), "op5-short")
    passed = _passes(taken, short)
    if passed is not None:
        short = short.join(passed.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("add") * F.col("size")).alias("went")), F.col("source").eqNullSafe(F.col("s")), "left")
        short = short.select("source", (F.col("short") - F.coalesce("went", F.lit(0))).alias("short"))
        passed = passed.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"), "add")
        hit = taken["source"].eqNullSafe(passed["s"]) & taken["id"].eqNullSafe(passed["i"]) & (taken["size"] == passed["z"])
        taken = taken.join(passed, hit, "left").withColumn("more", F.col("more") + F.coalesce("add", F.lit(0))).drop("s", "i", "z", "add")
        taken = store(taken, "op5-taken-ranks")
    candidates = taken.where(F.expr("more < rows and size > 0") & (F.col("whole") + 1 <= F.lit(float(most)))).join(short.where("short > 0"), same(taken, short)).drop(short.source)
    nearest = candidates.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("short")).alias("off"), "id", "size", "short")).alias("best"))
    nearest = nearest.where("best.off < best.short").select(F.col("source").alias("s"), F.col("best.id").alias("i"), F.col("best.size").alias("z"))
    hit = taken["source"].eqNullSafe(nearest["s"]) & taken["id"].eqNullSafe(nearest["i"]) & (taken["size"] == nearest["z"])
    return taken.join(nearest, hit, "left").withColumn("more", F.col("more") + F.when(F.col("z").isNotNull(), 1).otherwise(0)).drop("s", "i", "z", "rest", "bucket", "odds", "u", "chance")


def mix(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of `df`: id_col, size, source_size, target, taken."""
    rows = sampled_groups(df, id_col, **options).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("n") <= F.col("more"), 1).otherwise(0))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `df`, all columns, each as often as the mix takes it."""
    groups = sampled_groups(df, id_col, text_col, source_col, **options).where("size > 0 and whole + more > 0")
    groups = store(groups.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"), "whole", "more"), "op5-taken")
    rows = boxed(df, source=F.col(source_col), id=F.col(id_col), size=word_count(F.col(text_col)))
    rows = rows.join(groups, F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z")))
    n = F.row_number().over(Window.partitionBy("s", "i", "z").orderBy(F.lit(1)))
    copies = (F.col("whole") + F.when(F.col("n") <= F.col("more"), 1).otherwise(0)).cast("int")
    return unboxed(rows.withColumn("n", n).withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
