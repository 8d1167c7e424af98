"""Likeness from whole trees: exact at any length, by every phrase."""

import random
from collections import Counter

import pytest

from lumenrec.llm import fingerprints as P


def text_of(n, seed, lines=True):
    r = random.Random(seed)
    return "".join(f"w{seed}x{r.randrange(5000)}" + ("\n" if lines and r.random() < 0.1 else " ") for _ in range(n))


def flat_share(a, b):
    """By all phrases of both texts at once, without the tree."""
    def bag(t):
        s, sizes, _ = P.leaves([x.encode().split() for x in t.split("\n")])
        assert sizes.sum() == len(t.split())
        return Counter(zip((s[i : i + P.LEAF] for i in range(0, len(s), P.LEAF)), sizes.tolist()))

    x, y = bag(a), bag(b)
    weigh = lambda c: sum(n * size for (_, size), n in c.items())
    return 2 * weigh(x & y) / (weigh(x) + weigh(y))


@pytest.mark.parametrize("lines", [True, False])
@pytest.mark.parametrize("share", [0, 0.005, 0.5, 0.9, 0.9998])
def test_likeness_is_exact_on_long_texts(share, lines):
    a = text_of(40_000, 1, lines)
    k = round(len(a) * share)
    b = a[:k] + text_of(40_000, 2, lines)[k:]
    got = P.likeness_of(P.fingerprint_of(a), P.fingerprint_of(b))
    assert got == pytest.approx(flat_share(a, b), abs=1e-12) and abs(got - share) < 0.003
    assert (got > 0.9995) if share > 0.999 else True
    assert (got > 0.003) if share == 0.005 else True


def test_repeats_count_as_often_as_in_both():
    line = "one two three four five six\n"
    got = P.likeness_of(P.fingerprint_of(line * 30), P.fingerprint_of(line * 10))
    assert got == pytest.approx(0.5)


def test_the_fingerprint_holds_every_branch():
    text = "a b c\n\nd e\n" + text_of(300, 3)
    root, sections = P.tree_of(text)
    head, _, rest = P.fingerprint_of(text).partition(":")
    held = [s.split(",") for s in rest.split("/")]
    assert head == root and [s[0][: P.HASH] for s in held] == [P._short(h) for h, _ in sections]
    assert [[p[: P.HASH] for p in s[1:]] for s in held] == [[P._short(p[0]) for p in ps] for _, ps in sections]


def test_small_and_empty_texts():
    of = lambda a, b: P.likeness_of(P.fingerprint_of(a), P.fingerprint_of(b))
    assert of(None, "") == 1.0 and of("", " ") == 0.0 and of("a", "") == 0.0 and of("a b", "a  b") == P.BELOW_ONE and of("a", "b") == 0.0
