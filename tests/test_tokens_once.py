"""Sequences of samples that bring their tokens along."""

import random

from lumenrec.operators import interactions as I
from lumenrec.operators import tokens as K
from lumenrec.plans import registry

from .conftest import SF


def test_same_sequences_as_by_history_items(spark):
    """Hot users over several ranges, item 0, items without tokens, histories shorter than the samples'."""
    r = random.Random(3)
    data = [(u, i, 1.0, t) for u, n in ((1, 90), (2, 4), (3, 1), (4, 12)) for t, i in enumerate(r.choices(range(30), k=n))]
    rows = I.in_order(spark.createDataFrame(data, "user long, item long, rating double, ts long").repartition(3), 4)
    tokens = spark.createDataFrame([(i + 1, [i + 1, i + 40]) for i in range(25)], "item_id long, tokens array<int>")
    layout = {"mask": 91, "cls": 92, "sep": 93}
    for zero in (True, False):
        for n in (2, 5):
            one = K.masked_sequences(I.sliding_window_samples(rows, 5), tokens, layout, 2, n, drop_zero_item=zero)
            two = K.masked_sequences(I.sliding_window_samples(K.with_tokens(rows, tokens, 2), 5), tokens, layout, 2, n, drop_zero_item=zero)
            got = sorted(map(tuple, two.collect()))
            assert one.columns == two.columns and got == sorted(map(tuple, one.collect())) and len(got) > 90


def test_no_row_a_history_item(spark):
    plan = registry.QUERIES["masked_sequences"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
