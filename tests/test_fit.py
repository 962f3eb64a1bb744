from quire.operators import typography
from pyspark.sql import functions as F


def test_lines_stay_where_they_are_when_roles_are_fitted(spark):
    """Joined by role, all lines were the work of as many tasks as there are roles."""
    lines = spark.createDataFrame([("text", "iiii", 0.0, 12.0), ("note", "wwww", 0.0, 12.0), (None, "a", 0.0, 100.0), ("heading", None, 0.0, 9.0)], "role string, text string, x0 double, x1 double")
    profile = spark.createDataFrame([("text", [10.0, 11.0, 12.0]), ("heading", [14.0])], "role string, sizes array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fitted = typography.fit(lines, profile)
        plan = fitted._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(role" not in plan
        assert fitted.columns == ["role", "text", "x0", "x1", "size_pt", "overflow"]
        assert {(r.role, r.text, r.size_pt, r.overflow) for r in fitted.collect()} == {("text", "iiii", 12.0, False), ("note", "wwww", 10.0, True), (None, "a", 12.0, False), ("heading", None, 14.0, True)}
        assert [r[4:] for r in typography.fit(lines, profile.limit(0)).collect()] == [(None, None)] * 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_widths_are_counted_without_patterns(spark):
    texts = ["", " ", "Will (it) [fit]? 'so' | \\ ^ -", "ШЩЖЮшщжю@% mwMW", "плотно 𝒳", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", typography.advance(F.col("text"), F.lit(1000.0)).alias("wide")).collect()
    known = {c: n for p, n in typography.ADVANCE.values() for c in (p[1:-1].replace("\\", "") if p[0] == "[" else p)}
    assert [r.wide for r in rows] == [None if t is None else sum(known.get(c, 540) for c in t) for t in texts]
