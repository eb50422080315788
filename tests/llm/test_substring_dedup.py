import re

from xylem.llm import substring_dedup as s
from xylem.llm.common import word_hashes

from .conftest import NO_DOCS, hostile, word


def cut(sentence):
    """A sentence of too many words, cut by the rule for those."""
    if len(sentence) <= s.LONG:
        return [sentence]
    out, current = [], []
    for w, h in zip(sentence, word_hashes(" ".join(sentence)).tolist()):
        current.append(w)
        if h % s.CUT == 0:
            out.append(current)
            current = []
    return out + [current] if current else out


def brute(docs, span, min_words):
    """{(doc_id, text): numbers of the sentences that go}, straight from the definition."""
    runs = []
    for doc_id, text in docs:
        sentences, current = [], []
        for line in text.split("\n"):
            for piece in line.split():
                w = re.sub(r"[\W_]+", "", piece.lower())
                if w:
                    current.append(w)
                if piece[-1] in ".!?;:," and current:
                    sentences.append(current)
                    current = []
            if current:
                sentences.append(current)
                current = []
        sentences = [part for x in sentences for part in cut(x)]
        n = len(sentences)
        spans = set()
        for i in range(n):
            for lo, hi in ((i, None), (None, i)):
                if hi is None:
                    hi = i + span - 1
                    while hi < n and sum(map(len, sentences[lo : hi + 1])) < min_words:
                        hi += 1
                else:
                    lo = i - span + 1
                    while lo >= 0 and sum(map(len, sentences[lo : hi + 1])) < min_words:
                        lo -= 1
                if lo >= 0 and hi < n:
                    spans.add((lo, hi))
        runs += [(tuple(w for x in sentences[a : b + 1] for w in x), doc_id, a, b) for a, b in spans]
    gone, seen = {}, set()
    for words, doc_id, a, b in sorted(runs, key=lambda r: (r[1], r[2])):
        if words in seen:
            gone.setdefault(doc_id, set()).update(range(a, b + 1))
        seen.add(words)
    return gone


def test_against_brute_force(spark, rng, sentence):
    pool = [sentence(rng.randint(3, 9)) for _ in range(40)]
    docs = []
    for i in range(60):
        at = rng.randrange(30)
        own = [sentence(rng.randint(3, 9)) for _ in range(rng.randint(2, 8))]
        docs.append((i, " ".join(own[:2] + pool[at : at + rng.randint(0, 8)] + own[2:]).replace(". ", rng.choice([".\n", ". ", ".  "]))))
    want = brute(docs, 3, 20)
    assert len(want) > 15
    got = {r.doc_id: r for r in s.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == {i: len(x) for i, x in want.items()}
    for i, text in docs:  # what is left are words of the text in their order, without a change where nothing went
        assert (got[i].text == text) == (i not in want)
        left = iter(text.split())
        assert all(w in left for w in got[i].text.split())


def test_planted_passages(spark, rng, sentence):
    passage = " ".join(sentence(9) for _ in range(7))
    docs = [(i, " ".join([sentence() for _ in range(i % 3 + 1)] + [passage.upper() if i == 3 else passage] + [sentence()])) for i in range(6)] + [(9, " ".join(sentence() for _ in range(9)))]
    got = {r.doc_id: r.text for r in s.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage in got[0] and got[9] == docs[-1][1]
    assert all(passage[:60].lower() not in got[i].lower() and passage[-60:].lower() not in got[i].lower() for i in range(1, 6))


def test_passages_without_signs(spark, rng):
    """Text that has no sentence ends at all is cut by its words."""
    words = lambda n: " ".join(word(rng) for _ in range(n))
    passage = words(90)
    docs = [(i, f"{words(50)} {passage} {words(50)}") for i in range(5)]
    for r in s.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        left = [w for w in passage.split() if w in r.text.split()]
        assert r.doc_id == 0 and r.n_removed == 0 or r.doc_id and len(left) < 45
        assert all(w in r.text.split() for w in docs[r.doc_id][1].split()[:30] + docs[r.doc_id][1].split()[-30:])


def test_repeats_within_a_text(spark, sentence):
    block = " ".join(sentence(9) for _ in range(4))
    r = s.substring_dedup(spark.createDataFrame([(1, f"{block}\n{block}\n{block}")], "doc_id long, text string")).collect()[0]
    assert r.n_removed == 8 and r.text.split() == block.split()


def test_hostile_tables(spark):
    docs = hostile(spark)
    got = s.substring_dedup(docs)
    assert got.columns == [*docs.columns, "n_removed"] and got.count() == docs.count()
    rows = got.toDF("doc_id", "text", "lang", "source", "n_chars", "cell", "other", "n_removed").collect()
    assert [r.text for r in rows if r.doc_id == 2] == [None] and [r.text for r in rows if r.doc_id == 3] == [""]
    long = next(r for r in rows if r.doc_id == 5)
    assert long.n_removed > 39_000 and len(long.text) < 500
    assert s.clean(docs).columns == docs.columns
    assert s.substring_dedup(spark.createDataFrame([], NO_DOCS)).collect() == []
