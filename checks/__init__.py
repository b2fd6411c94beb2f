"""Registered queries with their SQL twins."""


def all_queries():
    from checks import distances, evaluation, evidence, fits, lattices, quality, rollups, serieschecks, sources, training  # noqa: F401
    from checks.registry import QUERIES, SQL

    return QUERIES, SQL
