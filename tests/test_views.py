"""Views of some analyses alone."""

from fitloom.sources import views


def test_views_of_some_analyses_are_cut_down_before_rows_are_numbered_or_repeated(spark, sf):
    keys = views.resumes(spark, sf).select("analysis_id").filter("analysis_id % 5 = 2")
    for view in (views.requirements, views.subfactors, views.skills, views.resumes):
        some, of_all = view(spark, sf, keys), view(spark, sf).join(keys, "analysis_id", "left_semi").select(*view(spark, sf).columns)
        assert some.schema == of_all.schema and 0 < some.count() < view(spark, sf).count()
        assert some.exceptAll(of_all).isEmpty() and of_all.exceptAll(some).isEmpty()
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Join LeftSemi")]
        assert "Generate" not in plan[len(above) :] and "Window" not in plan[len(above) :]
