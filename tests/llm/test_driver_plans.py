"""What a result's plan still holds, which is the driver's to plan."""

from fitloom.llm import jaccard


def test_what_goes_is_told_once_and_read_by_the_result(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, text + " more"), (4, "other words here"), (4, "other words here"), (5, ""), (None, text)], "doc_id long, text string")
    kept = jaccard.keep_one_of_each(docs)
    assert {f.split("/")[-2] for f in kept.inputFiles()} == {"told"}
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, text), (4, "other words here"), (5, "")]
