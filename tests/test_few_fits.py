"""Gram systems of a bounded number of fits."""

from hearken.operators.linear import gram_table


def test_rows_of_few_fits_are_not_gathered_by_key(spark):
    rows = spark.range(400).selectExpr("id % 4 AS held", "sin(id) AS f", "cos(id) AS y")
    plan = lambda **k: gram_table(rows, ["f"], "y", None, ["held"], limit=None, **k)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(few=True) and "strategy=broadcast" not in plan()
    same = [sorted(map(str, gram_table(rows, ["f"], "y", None, ["held"], limit=None, few=k).select("held", "n", "median").collect())) for k in (True, False)]
    assert same[0] == same[1]
