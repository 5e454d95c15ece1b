"""The classifier learns from what comes late in a long text."""

import random

from tallygraph.llm import quality
from tests.llm.data import prose


def test_learns_past_the_first_20000_characters(spark):
    rng = random.Random(4)
    tails = [prose(rng, 60) for _ in range(2)]
    docs = [(i, f"{prose(rng, 4500)} {tails[i % 2]} {tails[i % 2]}") for i in range(60)]
    assert min(t.index(tails[i % 2]) for i, t in docs) > 20_000
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(d, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int"))
    for k, text in ((1, model.good), (0, model.bad)):
        pieces = [tails[k][i : i + 16].encode() in text for i in range(0, len(tails[k]) - 16, 4)]
        assert sum(pieces) > 0.5 * len(pieces)
