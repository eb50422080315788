"""Operator 2: benchmark decontamination.

Seeds are the test items' word n-grams that are rare: the product of their words' frequencies in the corpus (counted over all documents)
is at most ``RARE``; the rarest of each item are seeds in any case. A document that holds a seed is joined to the
seed's items, and the passage around the seeds is aligned with the item's words (Smith-Waterman, word by word), which scores
edited and paraphrased copies too. Pairs that reach ``threshold`` of an unedited copy's score are contaminated.

The items' vocabulary and seeds are sent to every task while they stay below ``BROADCAST_SEEDS``; beyond that seeds are
joined to the documents' n-grams by a shuffle, with the same result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, each_word_array, gram_hashes, pick, positional, semi_or_anti, word_hashes

N = 3
#: Most that the product of a seed's word frequencies may be. A share, not a count: it means the same for any corpus.
RARE = 1e-8
#: Seeds that an item keeps however common they are.
LEAST_SEEDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
BROADCAST_SEEDS = 2_000_000


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two arrays of words and the end of its place in ``text`` (first of several)."""
    if not len(item) or not len(text):
        return 0, 0
    h = np.zeros(len(text) + 1, np.int32)
    slope = np.arange(len(text) + 1, dtype=np.int32) * GAP
    best, end = 0, 0
    for word in item:
        new = np.empty_like(h)
        new[0] = 0
        np.maximum(h[:-1] + np.where(text == word, MATCH, MISMATCH), h[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        # a gap in the item: the best of new[k] + GAP * (j - k)
        h = np.maximum.accumulate(new - slope) + slope
        if h.max() > best:
            end = int(h.argmax())
            best = int(h[end])
    return best, end


class Items:
    """Test items by number with their words, and the seeds' places."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words = ids, words

    def grams(self, k: int) -> np.ndarray:
        return gram_hashes(self.words[k], N)


def choose_seeds(items: Items, frequency: dict[int, float]) -> dict[int, list[tuple[int, int]]]:
    """From a seed's hash to its (item, place)."""
    seeds = defaultdict(list)
    for k, words in enumerate(items.words):
        p = np.array([frequency.get(int(w), 0.0) for w in words])
        n = min(N, len(words))
        share = np.array([p[i : i + n].prod() for i in range(len(words) - n + 1)])
        rare = np.flatnonzero(share <= RARE)
        if len(rare) < LEAST_SEEDS:
            rare = np.union1d(rare, np.argsort(share, kind="stable")[:LEAST_SEEDS])
        grams = items.grams(k)
        for i in rare:
            seeds[int(grams[i])].append((k, int(i)))
    return seeds


def _lengths(items: Items) -> list[int]:
    """The n-gram lengths in use: N, and those of items with fewer words."""
    return sorted({min(N, len(w)) for w in items.words})


def _count_words(vocabulary: np.ndarray):
    """(word, count) over the task's texts for the vocabulary's words, and under 0 for all words."""

    def of(batches):
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for w in each_word_array(batch.column(0)):
                total += len(w)
                if len(w) and len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
                    counts += np.bincount(at[vocabulary[at] == w], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([vocabulary, np.zeros(1, np.uint64)]).view(np.int64)), pa.array(np.concatenate([counts, [total]]))], names=["word", "n"])

    return of


def align(words: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Best score and its [begin, end) words: the passages around the hits (place in text, in item), each aligned."""
    m = len(item)
    spans = sorted((max(0, p - q - m // 2), min(len(words), p - q + m + m // 2)) for p, q in hits)
    merged = [list(spans[0])]
    for lo, hi in spans[1:]:
        if lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    best, begin, end = 0, 0, 0
    for lo, hi in merged:
        score, e = smith_waterman(item, words[lo:hi])
        if score > best:
            back, b = smith_waterman(item[::-1], words[lo : lo + e][::-1])
            best, end, begin = score, lo + e, lo + e - b if back == score else lo
    return best, begin, end


def _rows(out: list[tuple]) -> pa.RecordBatch:
    ids, item, score, begin, end = zip(*out) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "item_id", "score", "first_word", "after_word"])


_OUT = "doc_id long, item_id long, score double, first_word int, after_word int"


def _scored(words, hits, items: Items, threshold: float):
    for k, places in hits.items():
        item = items.words[k]
        score, begin, end = align(words, item, places)
        if (share := score / (MATCH * len(item))) >= threshold:
            yield items.ids[k], share, begin, end


def _search(items: Items, seeds: dict[int, list[tuple[int, int]]], threshold: float):
    keys = np.sort(np.array(list(seeds), np.uint64)) if seeds else np.empty(0, np.uint64)
    lengths = _lengths(items)

    def of(batches):
        for batch in batches:
            out = []
            for doc_id, words in zip(batch.column(0).to_pylist(), each_word_array(batch.column(1))):
                hits = defaultdict(list)
                for n in lengths:
                    if len(words) < n or not len(keys):
                        continue
                    g = gram_hashes(words, n)
                    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    for p in np.flatnonzero(keys[at] == g):
                        for k, q in seeds[int(g[p])]:
                            hits[k].append((int(p), q))
                if hits:
                    out += [(doc_id, *x) for x in _scored(words, hits, items, threshold)]
            yield _rows(out)

    return of


def _all_grams(lengths: list[int]):
    """(gram, tie, place) of every document: the side of the shuffled join."""

    def of(batches):
        for batch in batches:
            ties, grams, places = [], [], []
            for tie, words in zip(batch.column(0).to_pylist(), each_word_array(batch.column(1))):
                for n in lengths:
                    if len(words) >= n:
                        g = gram_hashes(words, n)
                        grams.append(g), ties.append(np.full(len(g), tie)), places.append(np.arange(len(g)))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(ties)), pa.array(np.concatenate(places).astype(np.int32))], names=["gram", "tie", "place"])

    return of


def _align_given(threshold: float):
    def of(batches):
        for batch in batches:
            out = []
            for doc_id, text, item_id, item_text, hits in zip(*(c.to_pylist() for c in batch.columns)):
                item = word_hashes(item_text)
                words = word_hashes(text)
                score, begin, end = align(words, item, [(h["place"], h["at"]) for h in hits])
                if (share := score / (MATCH * len(item))) >= threshold:
                    out.append((doc_id, item_id, share, begin, end))
            yield _rows(out)

    return of


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, after_word): the contaminated documents, once for each item and row of ``docs``.

    score is the alignment's share of an exact copy's score; the two word numbers bound the passage in the document. Null texts,
    texts and items without words, and items with a null id take no part; a null doc_id stays null in the result. An item of
    fewer than ``N`` words is one seed. Repeated items count once. Rows of documents that are repeated give repeated rows. Further
    columns are ignored. Without documents or items the result is empty.
    """
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    tests = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    spark = docs.sparkSession
    # the items' words travel to the driver only if there are few enough of them
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size / 6 <= broadcast_seeds:
        rows = [(r["item_id"], w) for r in tests.orderBy("item_id", "text").collect() if len(w := word_hashes(r["text"]))]
        items = Items([i for i, _ in rows], [w for _, w in rows])
        vocabulary = np.unique(np.concatenate([w for _, w in rows])) if rows else np.empty(0, np.uint64)
        counted = base.select("text").mapInArrow(_count_words(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        count = {r["word"] % (1 << 64): r["n"] for r in counted}
        total = max(1, count.get(0, 0))
        seeds = choose_seeds(items, {w: c / total for w, c in count.items()})
        return base.mapInArrow(_search(items, seeds, threshold), _OUT)
    return _by_shuffle(spark, base, tests, threshold)


def _item_grams(batches):
    """(item_id, n words, place, gram, word hashes of the gram) of every item."""
    for batch in batches:
        ids, at, grams, words = [], [], [], []
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = word_hashes(text)
            g = gram_hashes(w, N)
            n = min(N, len(w))
            for i in range(len(g)):
                ids.append(item_id), at.append(i), grams.append(int(g.view(np.int64)[i])), words.append(w[i : i + n].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(grams, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "at", "gram", "words"])


def _corpus_words(batches):
    """(word, count) of each batch."""
    for batch in batches:
        all_words = [w for w in each_word_array(batch.column(0)) if len(w)]
        v, c = np.unique(np.concatenate(all_words), return_counts=True) if all_words else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "n"])


def _by_shuffle(spark: SparkSession, base: DataFrame, tests: DataFrame, threshold: float) -> DataFrame:
    """The same for any number of items: word counts, seeds and hits are tables, joined by shuffles."""
    from pyspark.sql import Window

    places = cut(tests.withColumn("item", F.xxhash64("item_id", "text")).select("item", "text").mapInArrow(_item_grams, "item_id long, at int, gram long, words array<long>").withColumnRenamed("item_id", "item"))
    words = base.select("text").mapInArrow(_corpus_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(words)
    total = max(1, words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    share = (
        places.select("item", "at", "gram", F.explode("words").alias("word"))
        .join(words, "word", "left")
        .groupBy("item", "at", "gram")
        .agg(F.product(F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(total))).alias("p"))
    )
    seeds = share.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("p", "at"))).where((F.col("p") <= RARE) | (F.col("r") <= LEAST_SEEDS)).select("item", "at", "gram")
    keyed = base.withColumn("tie", F.xxhash64("doc_id", "text"))
    lengths = sorted(r["n"] for r in places.select(F.size("words").alias("n")).distinct().collect())  # of N values at most
    grams = keyed.select("tie", "text").dropDuplicates(["tie"]).mapInArrow(_all_grams(lengths), "gram long, tie long, place int")
    hits = grams.join(seeds, "gram").groupBy("tie", "item").agg(F.sort_array(F.collect_set(F.struct("place", "at"))).alias("hits"))
    named = tests.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.col("text").alias("item_text"))
    joined = keyed.join(hits, "tie").join(named, "item").select("doc_id", "text", "item_id", "item_text", "hits")
    return joined.mapInArrow(_align_given(threshold), _OUT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document isn't contaminated, with all columns; a row without doc_id is judged by its own text."""
    found = cut(decontaminate(docs, benchmark, threshold).select("doc_id").distinct())
    n = found.count()
    plain, at = positional(docs, "doc_id", "text")
    key = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("bad_id"))
    left = semi_or_anti(plain, key, F.col(at["doc_id"]).cast("long") == F.col("bad_id"), "left_anti", n)
    if found.where("doc_id IS NULL").limit(1).count():
        nameless = pick(docs, "doc_id", "text").where("doc_id IS NULL").select(F.xxhash64("text").alias("doc_id"), "text")
        bad = decontaminate(nameless, benchmark, threshold).select(F.col("doc_id").alias("bad_text")).distinct()
        left = left.join(bad, F.col(at["doc_id"]).isNull() & (F.xxhash64(at["text"]) == F.col("bad_text")), "left_anti")
    return left.toDF(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
