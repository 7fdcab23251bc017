"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Index: a table of postings (doc, term, position) of all documents, written to shared storage as segments of whole
documents, with a document's length as the posting of the empty term. A term that no test item uses can't be searched
for and isn't stored. Search: of every window of an item the two rarest terms are taken; each distinct pair of such terms
and their distance shifts the list of the rarest to meet the list of the second, once for all windows that ask it; what is left meets
the lists of all other terms of its windows, for the documents that still have a candidate. Full runs on one diagonal are matches.
Lists meet on document and position. The list of a rarest term is repeated for each second term and distance that windows
ask beside it: that number follows the test items and not the corpus.

Small tables (terms, pairs, candidate documents) are broadcast up to ``rows.BROADCAST_ROWS`` rows and ``rows.BROADCAST_BYTES`` bytes, counted
first, and joined by shuffle beyond that. Long documents are spread by their positions. Whole texts are shuffled only where the
documents that are hit may meet them (``sift``).

Defined results: null and empty texts have no words and are clean; an item without words never occurs; items with equal
words are found together; a null item_id counts its words as hit but isn't listed; rows that repeat an id are told apart
by their text's hash, and equal rows get equal results; empty tables give no matches; other columns are left alone, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.llm.rows import packed, small, spread
from fitloom.llm.sift import sifted
from fitloom.llm.urlfilter import LOWER, UPPER
from fitloom.plans.scratch import Scratch

#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc", "h"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


@dataclass
class PositionalIndex:
    """postings: doc_id, doc (never null), h (the text's hash), n_words, term, pos from 1 on; term 0 at pos 0 for each row."""

    postings: DataFrame
    scratch: Scratch

    @classmethod
    def build(cls, docs: DataFrame, terms: DataFrame, text: str = "text", doc_id: str = "doc_id") -> PositionalIndex:
        """Index the rows of ``docs`` by the words in ``terms`` (word, term)."""
        scratch = Scratch(docs.sparkSession, "index")
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), words_of(F.col(text)).alias("words"))
        rows = rows.select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
        empty = docs.sparkSession.createDataFrame([("", 0)], "word string, term bigint")
        known = small(terms.select("word", "term").unionByName(empty))
        found = rows.join(known, "word").select("doc_id", "h", "n_words", "term", "pos")
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
        return cls(scratch.keep(found, "postings").withColumn("doc", doc), scratch)

    def documents(self) -> DataFrame:
        return self.postings.filter("term = 0").select("doc_id", *DOC, F.col("n_words").cast("long").alias("n_words"))

    def frequencies(self) -> DataFrame:
        return self.postings.filter("term <> 0").groupBy("term").agg(F.count("*").alias("n"))

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """The lists of the terms: doc, h, term, pos."""
        lists = self.postings.filter("term <> 0").select(*DOC, "term", "pos")
        return lists.join(small(terms.select("term").distinct()), "term", "left_semi")


def phrases(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Items by their words: seq (a hash of the words), words, items (the ids)."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    return rows.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("seq", F.xxhash64("words"))


def terms_of(found: DataFrame) -> DataFrame:
    return found.select(F.explode("words").alias("word")).distinct().withColumn("term", F.xxhash64("word"))


def exact_matches(index: PositionalIndex, found: DataFrame, window: int = 10) -> DataFrame:
    """doc, h, seq, pos of every document word inside an occurrence of a window of ``window`` words of an item, or of a
    whole shorter item."""
    places = found.select("seq", F.least(F.size("words"), F.lit(window)).alias("w"), F.posexplode("words").alias("i", "word"), F.size("words").alias("n"))
    freq = index.frequencies()
    places = places.withColumn("term", F.xxhash64("word")).join(freq.withColumnRenamed("n", "freq"), "term", "left")
    places = index.scratch.keep(places.drop("word"), "places")

    # Each place is in the windows that start up to w - 1 before it.
    starts = F.sequence(F.greatest(F.col("i") - F.col("w") + 1, F.lit(0)), F.least(F.col("i"), F.col("n") - F.col("w")))
    inside = places.withColumn("start", F.explode(starts))
    of_window = W.partitionBy("seq", "start")
    rarest = inside.withColumn("known", F.count("freq").over(of_window)).filter("known = w")
    rarest = rarest.withColumn("k", F.row_number().over(of_window.orderBy("freq", "i")))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    pairs = rarest.groupBy("seq", "start").agg(
        F.max("w").alias("w"), pick(1, "i").alias("a"), pick(1, "term").alias("term_a"), F.coalesce(pick(2, "i"), pick(1, "i")).alias("b"), F.coalesce(pick(2, "term"), pick(1, "term")).alias("term_b")
    )
    # Windows that share both rarest places share the candidates.
    pairs = pairs.groupBy("seq", "a", "term_a", "b", "term_b").agg(F.max("w").alias("w"), F.collect_list("start").alias("starts"))
    pairs = index.scratch.keep(pairs, "pairs")

    asked = pairs.select("term_a", "term_b", (F.col("b") - F.col("a")).alias("apart")).distinct()
    first = index.postings.filter("term <> 0").select(*DOC, F.col("term").alias("term_a"), F.col("pos").alias("pos_a"))
    first = first.join(small(asked), "term_a").select(*DOC, "term_a", "pos_a", "apart", F.col("term_b").alias("term"), (F.col("pos_a") + F.col("apart")).alias("pos"))
    second = index.of_terms(pairs.select(F.col("term_b").alias("term")))
    met = first.join(second, [*DOC, "term", "pos"], "left_semi").withColumnRenamed("term", "term_b")
    windows = pairs.select("seq", "a", "b", "term_a", "term_b", (F.col("b") - F.col("a")).alias("apart"))
    left = met.join(small(windows), ["term_a", "term_b", "apart"]).select(*DOC, "seq", (F.col("pos_a") - F.col("a")).alias("diagonal"), "a", "b").distinct()
    left = index.scratch.keep(left, "candidates")

    # All places of the candidates' windows.
    wanted = left.join(small(pairs.select("seq", "a", "b", "w", "starts")), ["seq", "a", "b"])
    wanted = wanted.withColumn("start", F.explode("starts")).select(*DOC, "seq", "diagonal", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("w") - 1)).alias("i")).distinct()
    wanted = wanted.join(small(places.select("seq", "i", "term", "w")), ["seq", "i"])
    wanted = wanted.withColumn("pos", F.col("diagonal") + F.col("i"))
    lists = index.postings.filter("term <> 0").select(*DOC, "term", "pos").join(small(left.select(*DOC).distinct()), DOC, "left_semi")
    there = wanted.join(lists, [*DOC, "term", "pos"], "left_semi")

    run = W.partitionBy(*DOC, "seq", "diagonal")
    there = there.withColumn("island", F.col("i") - F.row_number().over(run.orderBy("i")))
    size = F.count("*").over(W.partitionBy(*DOC, "seq", "diagonal", "island"))
    return there.withColumn("size", size).filter("size >= w").select(*DOC, "seq", "pos")


def near_matches(index: PositionalIndex, found: DataFrame, slop: int) -> DataFrame:
    """doc_id, seq, pos: places of an item's rarest term with each of its other terms at most ``slop`` words away."""
    places = found.select("seq", F.explode(F.array_distinct("words")).alias("word")).withColumn("term", F.xxhash64("word"))
    places = places.join(index.frequencies(), "term", "left")
    of_item = W.partitionBy("seq")
    places = places.withColumn("all", F.count("*").over(of_item)).withColumn("known", F.count("n").over(of_item)).filter("known = all")
    places = index.scratch.keep(places.withColumn("k", F.row_number().over(of_item.orderBy("n", "term"))).drop("word", "n", "known"), "near")
    cell = F.floor(F.col("pos") / (slop + 1))
    lists = index.postings.filter("term <> 0")
    anchors = lists.join(small(places.filter("k = 1").select("term", "seq", "all")), "term").select("doc_id", *DOC, "seq", "all", "pos")
    around = anchors.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    around = around.join(small(places.filter("k > 1").select("seq", "term")), "seq")
    others = index.of_terms(places).withColumn("cell", cell).withColumnRenamed("pos", "at")
    met = around.join(others, [*DOC, "term", "cell"]).filter(F.abs(F.col("at") - F.col("pos")) <= slop)
    met = met.groupBy("doc_id", *DOC, "seq", "pos", "all").agg(F.count_distinct("term").alias("m")).filter("m = all - 1")
    alone = anchors.filter("all = 1")
    return met.select("doc_id", "seq", "pos").unionByName(alone.select("doc_id", "seq", "pos")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items (ids joined by commas, in the order of strings) of every row of ``docs``."""
    found = phrases(items)
    index = PositionalIndex.build(docs, terms_of(found))
    hits = index.scratch.keep(exact_matches(index, found, window), "hits")
    n_hit = hits.groupBy(*DOC).agg(F.count_distinct("pos").alias("n_hit"))
    listed = hits.select(*DOC, "seq").distinct().join(small(found.select("seq", "items")), "seq")
    listed = listed.select(*DOC, F.explode_outer("items").alias("item")).groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = index.documents().join(n_hit, DOC, "left").join(listed, DOC, "left")
    rows = rows.select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
    )
    return index.scratch.only(rows, "contamination")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a word inside an occurrence of a test window, with the columns of ``docs``."""
    hit = contamination(docs.select("doc_id", "text"), items, window).filter("n_hit > 0").select("doc_id", "h").distinct()
    # Clean texts are not shuffled for it, however many documents are hit.
    key = {"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    hit = hit.select(*[c.alias(n) for n, c in key.items()], "h")
    return spread(sifted(packed(docs, **key, h=F.xxhash64("text")), hit, ["none", "id", "h"], "left_anti"), docs)
