"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of all words, at most ``max_copies`` times its own words, the
excess reshared by weight. A document's expected copies go with its own weight, up to ``max_copies``; a source's scale is set so that
the words expected of its documents are its target, what some can't take being handed to the others. The whole part of that is certain; for
the rest, documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``, the odds of a fixed random number over the odds of inclusion, and the
lowest ranks are taken until the source's words reach the target. This gives samples of a fixed size with unequal probabilities.
A document that no longer fits leaves a gap. The ranking is gone on with among documents of at most the gap, to the next that doesn't fit; what
is then left is filled from the first ``PER_CLASS`` of each class of sizes (powers of two), the larger classes first, and at last by the one
of them that comes nearest. These few, a source's last, are drawn with a bias towards sizes that fit. So a source misses its target by half of the smallest
document left at most, but where all that it has left is smaller still or it has no more to give.

The cut in the ranking is found without sorting a source: ranks fall into 2048 x 1024 buckets, two aggregations find the
bucket of the cut, and only that bucket's rows are put in order. Rows of a hot source are only ever pre-aggregated.
The random number is a hash of the seed and the document's id, so reruns agree, also after lost executors.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; null ids take part like any id; rows that repeat an id share its random number and each count; an empty table
gives an empty mix. Columns other than those named are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
PER_CLASS = 16


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` that aren't keys; null keys equal null keys."""
    names = {k: f"__{k}" for k in keys}
    other = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = [left[k].eqNullSafe(other[names[k]]) for k in keys]
    return left.join(other, on, how).drop(*names.values())


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with rank, from 0 on, by code point, null last: sorted in ranges, so no task holds all of them."""
    order = F.col("source").asc_nulls_last()
    parts = scratch.keep(sources.orderBy(order).withColumn("range", F.spark_partition_id()), "sources")
    # A row for each range.
    before = F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    counts = parts.groupBy("range").count().select("range", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("range").orderBy(order)) - 1
    return parts.withColumn("own", own).join(F.broadcast(counts), "range").withColumn("rank", F.col("before") + F.col("own")).drop("range", "before", "own")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """A row per source: source_size, weight, target (words).

    ``sizes`` has source and size. Sources take ``weights`` in turn, by code point, null last. The sources at their limit
    are a prefix in the order of limit over weight. Sums over buckets of that ratio (2 % wide, so a few thousand rows) tell the
    bucket in which the prefix ends; only the sources of that bucket are put in order.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "targets")
    picks = F.array(*[F.lit(w) for w in weights])
    s = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    s = s.withColumn("weight", F.get(picks, (F.col("rank") % len(weights)).cast("int"))).withColumn("limit", F.col("source_size") * max_copies)
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    s = scratch.keep(s.withColumn("bucket", F.when(F.col("limit") > 0, F.floor(F.log2("ratio") * 32).cast("int")).otherwise(-(1 << 30))), "ratios")
    sums = s.groupBy("bucket").agg(F.sum("limit").alias("limits"), F.sum("weight").alias("weights"), F.sum("source_size").alias("sizes"), F.max("ratio").alias("most"))
    upto, everything = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total, left = F.sum("sizes").over(everything), F.sum("weights").over(everything) - F.sum("weights").over(upto)
    reached = F.sum("limits").over(upto) + F.col("most") * left >= total
    sums = sums.select("bucket", reached.alias("reached"), total.alias("total"), (F.sum("limits").over(upto) - F.col("limits")).alias("limits"), (left + F.col("weights")).alias("left"))
    first = sums.filter("reached").agg(F.min_by(F.struct("bucket", "total", "limits", "left"), "bucket").alias("f")).select("f.*")
    by_ratio = W.partitionBy("bucket").orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    inside = s.join(F.broadcast(first), "bucket")
    level = (F.col("total") - F.col("limits") - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0))) / (F.col("left") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    inside = inside.select("ratio", level.alias("level")).filter("ratio >= level")
    # The first source that isn't full sets the level of all that follow.
    shared = inside.agg(F.min(F.struct("ratio", "level")).alias("s")).select("s.level").scalar()
    limit = F.col("limit").cast("double")
    target = F.when(shared.isNull() | (F.col("ratio") < shared), limit).otherwise(F.least(limit, F.col("weight") * shared))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def scales(rows: DataFrame, aims: DataFrame, max_copies: int) -> DataFrame:
    """source and scale: a document's expected copies are scale times its weight, ``max_copies`` at most. rows: source, size, w.

    Documents at their limit are those of the largest weights. Sums over buckets of the weight, 1 % wide, tell which. No scale: a source without weights."""
    bucket = F.floor(F.log2("w") * 64).cast("int")
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    sums = rows.filter("size > 0 and w > 0").groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), exact(F.col("w") * F.col("size")).alias("weighed"), F.max("w").alias("most"))
    sums = same_keys(sums, aims.select("source", "target"), ["source"])
    above = W.partitionBy("source").orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("weighed").over(W.partitionBy("source").orderBy(F.col("bucket").desc()).rowsBetween(0, W.unboundedFollowing))
    sums = sums.withColumn("scale", (F.col("target") - max_copies * F.coalesce(F.sum("words").over(above), F.lit(0))) / left)
    holds = F.col("scale") * F.col("most") <= max_copies
    return sums.groupBy("source").agg(F.coalesce(F.max_by("scale", F.when(holds, F.col("bucket"))), F.lit(1e300)).alias("scale"))


def _cut(free: DataFrame, need: DataFrame) -> DataFrame:
    """source, cut1, cut2, upto: where the ranking of ``free`` is cut so that the words before fit ``need`` (source, need). None: all fit."""

    def cut(parts: DataFrame, keys: list[str], bucket: str, need: DataFrame) -> DataFrame:
        """For each key, the first bucket whose words don't all fit, and what is left for it."""
        sums = parts.groupBy(*keys, bucket).agg(F.sum("size").alias("words"))
        sums = same_keys(sums, need, keys)
        run = F.sum("words").over(W.partitionBy(*keys).orderBy(bucket))
        sums = sums.withColumn("run", run).filter(F.col("run") > F.col("need"))
        first = F.row_number().over(W.partitionBy(*keys).orderBy(bucket))
        return sums.withColumn("k", first).filter("k = 1").select(*keys, bucket, (F.col("need") - (F.col("run") - F.col("words"))).alias("need"))

    cut1 = cut(free, ["source"], "b1", need)
    inside = same_keys(free, cut1.select("source", "b1"), ["source", "b1"])
    cut2 = cut(inside, ["source", "b1"], "b2", cut1.select("source", "b1", "need"))
    edge = same_keys(inside, cut2, ["source", "b1", "b2"])
    run = F.sum("size").over(W.partitionBy("source", "b1", "b2").orderBy(*KEY))
    fits = F.col("run") <= F.col("need")
    edge = edge.withColumn("run", run)
    return edge.groupBy("source").agg(F.first("b1").alias("cut1"), F.first("b2").alias("cut2"), F.max(F.when(fits, F.struct(*KEY))).alias("upto"))


#: The order of the ranking.
KEY = ["t", "u", "doc_id", "size"]


def _drawn(rows: DataFrame, able: Column, need: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with those of ``able`` drawn that come first in the ranking and fit ``need`` (source, need), and what is left of ``need``."""
    rows = same_keys(rows, need, ["source"], "left").withColumn("__able", F.coalesce(able & F.col("need").isNotNull(), F.lit(False)))
    rows = same_keys(rows, _cut(rows.filter("__able").drop("need"), need), ["source"], "left")
    here, at = F.struct("b1", "b2"), F.struct(F.col("cut1"), F.col("cut2"))
    before = (here < at) | ((here == at) & F.coalesce(F.struct(*KEY) <= F.col("upto"), F.lit(False)))
    rows = rows.withColumn("drawn", F.col("drawn") | F.col("__able") & (F.col("cut1").isNull() | before)).withColumn("__now", F.col("drawn") & F.col("__able"))
    rows = scratch.keep(rows.drop("cut1", "cut2", "upto", "__able", "need"), name)
    words = rows.groupBy("source").agg(F.sum(F.when(F.col("__now"), F.col("size")).otherwise(0)).alias("words"))
    left = same_keys(need, words, ["source"]).select("source", (F.col("need") - F.col("words")).alias("need")).filter("need > 0")
    return rows.drop("__now"), left


def _fillers(rows: DataFrame, need: DataFrame) -> DataFrame:
    """source, doc_id, size of the documents that fill what is left."""
    free = same_keys(rows.filter("t is not null and not drawn").select("source", *KEY), need, ["source"]).filter("size < 2 * need")
    free = free.withColumn("class", F.floor(F.log2("size")).cast("int"))
    first = F.row_number().over(W.partitionBy("source", "class").orderBy(*KEY))
    free = free.withColumn("k", first).filter(f"k <= {PER_CLASS}")
    some = free.groupBy("source").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct((-F.col("class")).alias("order"), *KEY))).alias("some"))

    def add(done: Column, x: Column) -> Column:
        fits = x["size"] <= done["need"]
        return F.struct((done["need"] - F.when(fits, x["size"]).otherwise(0)).alias("need"), F.array_append(done["took"], fits).alias("took"))

    some = some.withColumn("fold", F.aggregate("some", F.struct(F.col("need"), F.array().cast("array<boolean>").alias("took")), add))
    gap = F.col("fold.need")
    others = F.filter(F.col("some"), lambda x, i: ~F.get(F.col("fold.took"), i) & (F.abs(x["size"] - gap) < gap))
    last = F.array_min(F.transform(others, lambda x: F.struct(F.abs(x["size"] - gap).alias("off"), *[x[n].alias(n) for n in KEY])))
    taken = F.transform(F.filter(F.col("some"), lambda x, i: F.get(F.col("fold.took"), i)), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size")))
    taken = F.array_compact(F.array_append(taken, F.when(last.isNotNull(), F.struct(last["doc_id"].alias("doc_id"), last["size"].alias("size")))))
    return some.select("source", F.explode(taken).alias("x")).select("source", "x.*").distinct()


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weight: str | Callable[[Column], Column] | None = None,
    weights: tuple[int, ...] = (1, 2, 3),
    max_copies: int = 3,
    seed: str = "mix-1:",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs``.

    ``weight`` names a column of numbers, or makes one of a document's size: a document's chance goes with it (null, not a number or
    below 0: none). Without it, all are alike.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    given = F.col(f"`{weight}`") if isinstance(weight, str) else F.lit(None)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), given.cast("double").alias("w"), _uniform(F.col(doc_id), seed).alias("u"))
    w = F.lit(1.0) if weight is None else F.col("w") if isinstance(weight, str) else weight(F.col("size")).cast("double")
    rows = rows.withColumn("w", F.when(F.isnan(w) | (w < 0), 0.0).otherwise(F.coalesce(w, F.lit(0.0))))
    rows = scratch.keep(rows, "sizes")
    aims = targets(rows.select("source", "size"), weights, max_copies, scratch)
    aims = scratch.keep(same_keys(aims.drop("weight"), scales(rows, aims, max_copies), ["source"], "left"), "targets")

    rows = same_keys(rows, aims, ["source"])
    chance = F.when(F.col("scale").isNull(), F.col("target") / F.col("source_size")).otherwise(F.col("scale") * F.col("w"))
    expected = F.when(F.col("size") > 0, F.least(chance, F.lit(float(max_copies)))).otherwise(0.0)
    rows = rows.withColumn("certain", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    able = (F.col("size") > 0) & (F.col("certain") < max_copies)
    # A document without a fractional chance comes after all others, in the order of u.
    rows = rows.withColumn("t", F.when(able & (F.col("p") > 0), odds / (1 + odds)).when(able, 1 + F.col("u"))).drop("w", "p", "scale")
    cell = F.floor(F.col("t") * (BUCKETS * BUCKETS))
    rows = rows.withColumn("b1", F.floor(cell / BUCKETS).cast("int")).withColumn("b2", (cell % BUCKETS).cast("int")).withColumn("drawn", F.lit(False))

    # Where the certain copies reach the target, nothing is drawn and nothing is put in order.
    need = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("need")).filter("need > 0")
    need = scratch.keep(need, "need")
    rows, need = _drawn(rows, F.col("t").isNotNull(), need, scratch, "drawn")
    need = scratch.keep(need, "gap")
    rows, need = _drawn(rows, F.col("t").isNotNull() & ~F.col("drawn") & (F.col("size") <= F.col("need")), need, scratch, "drawn2")
    fill = _fillers(rows, need).withColumn("fills", F.lit(True))
    # Rows that repeat an id and a size are alike: all of them fill a gap or none.
    rows = same_keys(rows, fill, ["source", "doc_id", "size"], "left")
    copies = (F.col("certain") + F.when(F.col("drawn") | (F.col("t").isNotNull() & F.coalesce("fills", F.lit(False))), 1).otherwise(0)).cast("long")
    return scratch.only(rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")), "mix")
