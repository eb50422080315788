import random

import pytest

from xylem.functions import interp

from .test_plain import OFTEN, PIECES


@pytest.mark.parametrize("path", ["/*", "/a"])
def test_straight_from_the_tokens(path):
    """The same as by a tree, which a path with a predicate takes."""
    rng, n = random.Random(3), 0
    for _ in range(4000):
        xml = "".join(rng.choices(PIECES, OFTEN, k=rng.choice([0, 1, 3, 8, 20])))
        want = interp.canonical(xml, path + "[true()]")
        assert interp.canonical(xml, path) == want, xml
        n += len(want)
    assert n > 300


def test_no_tree_is_made(monkeypatch):
    def fail(*_):
        raise AssertionError("a tree")

    monkeypatch.setattr(interp, "Tree", fail)
    assert interp.canonical("<a y='1' x='&lt;'>t&amp;<b/></a>", "/a") == ['<a x="&lt;" y="1">t&amp;<b></b></a>']
