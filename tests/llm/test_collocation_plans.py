"""Tables that are exploded before a join are not broadcast: the planner sizes them by the rows before."""

from hearken.llm import collocations
from hearken.llm.common import stored


def test_exploded_sides_are_not_broadcast(spark):
    ids = [([k], 90 + k) for k in range(1, 9)] + [([k, k + 1], 40 + k) for k in range(1, 8)] + [([1, 2, 3], 39)]
    found = stored(spark.createDataFrame(ids, "ids array<long>, a long"))
    words = stored(spark.createDataFrame([(k, "en", f"w{k}", 90 + k) for k in range(1, 9)], "id long, lang string, word string, n long"))
    scored = stored(collocations.cohesion(found))
    kept = collocations.not_absorbed(scored, 80)
    text = collocations.spelt(kept, words)
    for made in (collocations.cohesion(found), kept, text):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["a"], r["l"], r["r"]) for r in scored.filter("size(ids) = 2").collect()} == {(40 + k, 90 + k, 91 + k) for k in range(1, 8)}
    # "w1 w2" (41) and "w2 w3" (42) are absorbed by the phrase of three (39)
    assert sorted(r["phrase"] for r in text.collect()) == ["w1 w2 w3", *[f"w{k} w{k + 1}" for k in range(3, 8)]]
