"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor kept. All but the last
return the columns of documents. ``docs`` needs doc_id (an integer), text and, for the last stage, source; other columns are
carried along whatever their names. An empty table gives an empty table. Texts of any length are taken whole. What a stage makes of
null ids and texts, ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm import decontaminate, jaccard, mixing, quality, substrings
from fitloom.llm.rows import packed, small, spread
from fitloom.plans.scratch import Scratch, swept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition, length and symbol rules reject go. Each row is judged by its text alone: a null, empty or blank text
    goes (under 20 words), a null id matters not, and repeated rows stay or go together."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest doc_id (five-word shingles, 0.8). A null id is the last of
    its class; of one id's texts in a class the smallest hash stays, of equal rows one; rows without words (null, empty) all stay."""
    return jaccard.keep_one_of_each(docs, k=5, num=80, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that a document with a smaller doc_id has are cut out; a text of which nothing is left goes. A null or
    empty text stays as it is; a null id is neither earlier nor later; rows that repeat an id don't cut each other."""
    return substrings.cut_repeats(docs, window=13)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a 10-word window of a benchmark item, or a whole shorter item, go. Null and empty texts are clean and stay; items
    without words occur nowhere; a null id is judged like any; equal rows stay or go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document taken, with how many copies and words of it; documents without a copy go, such as null and empty texts.
    A null source is a source of its own, a null id an id; rows that repeat an id and a size are taken alike; own columns named copies
    or taken give way to those of the mix."""
    taken = mixing.mix(docs.select("doc_id", "text", "source")).filter("copies > 0").distinct()
    taken = small(taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("n"), "copies", "taken"))
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=mixing.size_of(F.col("text")))
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("n")))
    return spread(rows, docs, copies=F.col("copies"), taken=F.col("taken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

#: The stages are each tested against brute force instead; together they are too long a statement to be checked by eye.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = list(scratch.names)
        with swept(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {}
