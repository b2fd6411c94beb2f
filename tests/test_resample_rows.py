"""Redrawn rows are summed by item before they meet another table."""

from __future__ import annotations

from checks import training


def test_redrawn_rows_are_not_shuffled_to_the_join(spark, sf):
    plan = [line.strip() for line in training.j14(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    drawn = next(i for i, line in enumerate(plan) if "FlatMapGroupsInArrow" in line)
    join = max(i for i, line in enumerate(plan[:drawn]) if "Join LeftOuter" in line)
    assert any("Aggregate [" in line for line in plan[join:drawn])


def test_replicates_are_counted_once_each(spark, sf):
    rows = training.j14(spark, sf).collect()
    assert rows and all(r.replicates == 500 and r.n_rows % 500 == 0 and r.in_range and r.items_known for r in rows)
