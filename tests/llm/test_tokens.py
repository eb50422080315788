"""Operators 8 and 9, against the tokenizer applied to whole texts."""

import base64

import numpy as np
import pytest

from xylem.llm import token_codes as c
from xylem.llm import token_counts as k
from xylem.llm.tokens import PATTERN, TOKENIZER, chunks

from .conftest import NO_DOCS, hostile, word


@pytest.fixture(scope="module")
def whole():
    import tiktoken

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts(rng):
    odd = ["", " ", "  a", "a  b", "a \n b", "\n\n", "don't  stop", "x" * 3000, "日本語 テキスト", "😀 😀", "a b c d", "tab\tand  spaces   ", "1234567 89", "  ", "a b ", " a", "\r\n x", "é́ x"]
    return odd + ["".join(rng.choice([word(rng), " ", "  ", "\n", "7", ".", "'s", "é"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]


def test_chunks_give_the_ids_of_the_whole_text(rng, whole):
    t = chunks()
    for text in texts(rng):
        assert t.encode(text).tolist() == whole(text), repr(text)
        assert t.length(text) == len(whole(text))


def test_codes_round_trip_and_access(rng):
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = np.array([rng.choice([0, 5, 255, 256, 65535, 65536, 2**32 - 1, rng.randrange(50_000)]) for _ in range(n)], np.uint32)
        codes = c.encode(ids)
        assert c.size(codes) == n and c.decode(codes).tolist() == ids.tolist()
        assert [c.access(codes, i) for i in range(n)] == ids.tolist()
        for bad in (-1, n):
            with pytest.raises(IndexError):
                c.access(codes, bad)


def test_codes_of_documents(spark, rng, whole):
    docs = list(enumerate(texts(rng)))
    for r in c.token_codes(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert c.decode(r.codes).tolist() == whole(docs[r.doc_id][1]) and r.n_tokens == c.size(r.codes)


def splice(text, edits):
    out, at = [], 0
    for start, stop, new in edits:
        out += [text[at:start], new]
        at = stop
    return "".join(out) + text[at:]


def random_edits(rng, text, most=3):
    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randint(0, most)))
    return [(a, b, rng.choice(["", " ", "x", " new words ", "\n", "'s", "7", "、", "\x1c"])) for a, b in zip(cuts[::2], cuts[1::2])]


def test_counts_follow_edits(rng, whole):
    """Four batches of edits one after the other, the tree kept as bytes in between."""
    t = chunks()
    saved = 0
    for text in [*texts(rng), *("".join(rng.choice(["日本", "語、", "'", "s", "12", "x", "。", "ll"]) for _ in range(80)) for _ in range(40))]:
        tree = k.CountTree(text, t)
        assert tree.total == len(whole(text))
        for _ in range(4):
            edits = random_edits(rng, text)
            before, tree.reencoded = tree.n, 0
            want = splice(text, edits)
            assert tree.apply(edits) == want
            assert tree.total == len(whole(want)), (text, edits)
            saved += tree.reencoded < before
            text = want
            tree = k.CountTree(text, t, tree.to_bytes())
            size = len(tree.chars) // 2
            assert tree.chars[1] == len(text) and (tree.chars[1:size] == tree.chars[2 : 2 * size : 2] + tree.chars[3 : 2 * size : 2]).all()
            assert (tree.tokens[1:size] == tree.tokens[2 : 2 * size : 2] + tree.tokens[3 : 2 * size : 2]).all()
    assert saved > 300


def test_a_small_edit_of_a_long_text_is_cheap(rng, whole):
    for text in (" ".join(word(rng) for _ in range(20_000)), "日本語、" * 20_000, "a1-" * 20_000):
        kept = k.CountTree(text, chunks()).to_bytes()
        tree = k.CountTree(text, chunks(), kept)
        for _ in range(3):
            tree.apply([(1000, 1004, "something else")])
        assert tree.reencoded <= 30 and tree.total == len(whole(tree.text))


def test_edits_from_a_table(spark, whole):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 4, 7, "2 and a half"), (1, 0, 3, None), (9, 0, 1, "x"), (None, 0, 1, "x"), (2, None, 3, "x"), (2, 3, 400, "")], "doc_id long, start int, stop int, text string")
    done = k.edited(k.count_trees(docs), edits)
    got = {r.doc_id: r for r in done.collect()}
    assert got[1].n_tokens_after == len(whole(" 2 and a half three")) and got[2].n_tokens_after == len(whole("fou")) and got[3].n_tokens_after is None
    again = {r.doc_id: r for r in k.edited(done, spark.createDataFrame([(1, 0, 1, "")], edits.schema)).collect()}
    assert again[1].text == "2 and a half three" and again[1].n_tokens_after == len(whole(again[1].text)) and again[1].n_tokens == got[1].n_tokens_after
    assert again[2].n_reencoded == 0 and again[2].n_tokens_after == got[2].n_tokens_after


def test_hostile_tables(spark, whole):
    docs = hostile(spark, [(7, "call 12345678 now\n" + "a line that comes again, later\n" * 2, None, None, None, None, None)])
    coded, counted = c.token_codes(docs).collect(), k.token_counts(docs).collect()
    assert len(coded) == len(counted) == docs.count()
    assert [(r.n_tokens, r.codes) for r in coded if r.doc_id == 2] == [(None, None)] and [r.n_tokens for r in coded if r.doc_id == 3] == [0]
    for r in counted:
        assert r.doc_id != 7 or r.n_tokens_after == len(whole("call [number] now\na line that comes again, later\n")) and r.n_edits == 2
    none = spark.createDataFrame([], NO_DOCS)
    assert c.token_codes(none).collect() == [] and k.token_counts(none).collect() == []
