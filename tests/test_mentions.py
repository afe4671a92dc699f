"""Names in texts: the texts' words are never broadcast, and both ways to join give the same rows."""

import pytest
from conftest import SMALL

from quillgraph.operators import facts as A
from quillgraph.plans import catalog


def test_words_of_texts_are_not_broadcast(spark):
    plan = catalog.queries()["entity_mentions_in_text"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("few", [0, 20_000])
def test_few_and_many_variants(spark, monkeypatch, few):
    monkeypatch.setattr(A, "FEW_VARIANTS", few)
    names = spark.createDataFrame([("Old Red Barn", ["The Barn"]), ("Blue House", None), ("Inn", None), (None, None)], "name string, aliases array<string>")
    texts = spark.createDataFrame([(1, "an old, red barn"), (1, "blue house"), (2, "the barn inn"), (3, "bluehouse"), (4, None), (5, ""), (None, "red barn red barn")], "id int, text string")
    got = sorted(map(tuple, A.mentioned(names, texts).collect()), key=str)
    assert got == sorted([(1, "Old Red Barn"), (1, "Blue House"), (2, "Old Red Barn"), (None, "Old Red Barn")], key=str)
