"""What is shuffled and what stays on disk while an operator runs."""

import os
import random
import time

from fitloom.llm import decontaminate, jaccard
from fitloom.plans.scratch import Scratch


def shuffled(spark):
    """Bytes of shuffle written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_clean_texts_are_not_shuffled_to_meet_what_is_hit(spark):
    rng = random.Random(3)
    rows = [(i or None, " ".join(f"{rng.getrandbits(60):x}" for _ in range(1500))) for i in range(200)]
    items = spark.createDataFrame([("a", " ".join(rows[7][1].split()[20:40])), ("b", " ".join(rows[0][1].split()[20:40]))], "item_id string, text string")
    docs, threshold = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when many documents are hit
    try:
        kept = decontaminate.drop_contaminated(docs, items)
        before = shuffled(spark)
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(1, 200) if i != 7]
        assert shuffled(spark) - before < 0.1 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_shuffle_files_of_what_is_written_go_with_the_statement(spark):
    before = shuffle_files(spark)
    kept = Scratch(spark, "disk").keep(spark.range(1000).groupBy("id").count().repartition(3, "count"), "counts")
    assert kept.count() == 1000
    left = shuffle_files(spark) - before
    for _ in range(50):
        if len({f.split("_")[1] for f in left}) <= 1:
            break
        time.sleep(0.1)
        left = shuffle_files(spark) - before
    # Those of the count itself, which writes nothing, may stay.
    assert len({f.split("_")[1] for f in left}) <= 1


def test_the_set_join_keeps_what_it_still_reads(spark, monkeypatch):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(base + [t + " end" for t in base])), "doc_id long, text string")
    scratch, there, components = Scratch(spark, "disk"), [], jaccard.components

    def seen(edges):
        there.extend(os.listdir(scratch.path.removeprefix("file:")))
        return components(edges)

    monkeypatch.setattr(jaccard, "components", seen)
    found = jaccard._classes(docs, 5, 80, 100, scratch)
    assert sorted(there) == ["links-across", "links-inside", "rows"]
    assert found.select("class").distinct().count() == 20
