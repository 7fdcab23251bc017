"""What the plan of fit_analysis works out per row."""

from fitloom.operators import scoring
from fitloom.sources import views


def test_a_category_filters_its_requirements_once_and_reads_no_format(spark, sf):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        rows = scoring.fit_analysis(*[view(spark, sf) for view in (views.requirements, views.subfactors, views.skills, views.resumes)])
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "format_string" not in plan
    own = [part for part in plan.split("filter(requirements")[1:] if "primary_category = " in part.split("lambda x")[1]]
    assert len(own) == 1
