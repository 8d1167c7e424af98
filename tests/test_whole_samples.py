"""The three sequence queries over all training samples, against brute force."""

import pytest

from lumenrec.plans import codes, registry
from lumenrec.plans import tables as T

from .conftest import SF

NAMES = ["generative_sequences", "masked_sequences", "retrieval_sequences"]


@pytest.fixture(scope="module")
def parts(spark):
    """Every sample as (user, pos): (history of five at most, target), the tokens by item_id, and the layout."""
    users, samples = {}, {}
    for r in T.ordered(spark, SF).select("user", "pos", "item").collect():
        users.setdefault(r.user, []).append((r.pos, r.item))
    for user, seen in users.items():
        seen = [i for _, i in sorted(seen)]
        for p in range(1, len(seen) - 2):
            samples[user, p] = [i for i in seen[max(0, p - 5) : p] if i != 0], seen[p]
    tokens, layout = codes.tokens_of(spark, SF)
    return samples, {r.item_id: list(r.tokens) for r in tokens.collect()}, layout


def built(name, history, target, tokens, layout):
    flat = [t for i in history for t in tokens.get(i + 1, [0] * 4)]
    pads, goal = [0] * (20 - len(flat)), tokens.get(target + 1, [0] * 4)
    if name == "generative_sequences":
        return pads + flat, goal
    if name == "masked_sequences":
        return pads + [layout["cls"], *flat, layout["sep"]] + [layout["mask"]] * 4, goal
    n = len(history)
    return [i + 1 for i in history] + [0] * (5 - n), ([-100] * (n - 1) + [target] if n else []) + [-100] * (5 - n)


@pytest.mark.parametrize("name", NAMES)
def test_every_sample_gives_a_sequence(name, spark, parts):
    samples, tokens, layout = parts
    second = {"generative_sequences": "labels", "masked_sequences": "target_codes", "retrieval_sequences": "labels_seq"}[name]
    rows = registry.QUERIES[name](spark, SF).collect()
    got = {(r.user, r.pos): (r.input_ids, r[second]) for r in rows}
    want = {k: tuple(",".join(map(str, x)) for x in built(name, *v, tokens, layout)) for k, v in samples.items()}
    assert len(rows) == len(want) and got == want
