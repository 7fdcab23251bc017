from fitloom.operators import validation
from fitloom.queries.judgement import drafts
from fitloom.sources import views
from fitloom.streaming.drafts import accept


def test_streamed_drafts_equal_a_batch(spark, sf, tmp_path):
    rows = drafts(views.requirements(spark, sf).filter("analysis_id % 5 = 0"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    accept(stream, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/check").awaitTermination()
    want = validation.validate(rows)
    got = spark.read.parquet(f"{tmp_path}/bad").select("analysis_id", "reason")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.filter("reason is not null").select("analysis_id", "reason").collect()))
    assert spark.read.parquet(f"{tmp_path}/ok").count() == validation.requirements_of(want).count() > 0
