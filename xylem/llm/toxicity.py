"""Operator 5: toxicity by a convolutional text classifier, trained in numpy.

Words are hashed, and so are their beginnings (``STEMS`` bytes, for inflected and compound forms); hashes of the training texts have an
embedding row, all others are zero, and a word's embedding is the sum of its rows. Filters of several widths run over the
text; the greatest values of each (the maximum and the next ``TOP`` - 1 different ones, over the whole text, however long) feed a logistic unit. The first component of a row starts as the word's smoothed
log-odds of occurring in toxic texts, the others as small values drawn from the hash; then rows, filters and the unit are
trained by AdaGrad. The threshold of each language is set on all labelled documents outside training, scored where they lie. As training takes
toxic and other documents at a share of its own, the rest of each kind is weighted up to the number of all labelled documents of that kind.

Training uses at most ``TOXIC_ROWS`` toxic and ``OTHER_ROWS`` other labelled documents, those with the least hash of doc_id: a bound on the
model's training alone. Every document is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, each_word_array, mix, pick

TOXIC_ROWS, OTHER_ROWS = 2000, 4000
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
#: Lengths of the beginnings, and how many of a filter's greatest values (different ones) go on.
STEMS, TOP = (5, 7), 3
#: A word has a row if it is in so many training texts.
LEAST_TEXTS = 3
EPOCHS, RATE, DECAY = 5, 0.05, 1e-4
#: Divisors of the log-odds that rows start with: of all, and more for rare words.
ODDS, SHRINK = 6, 5
#: A part of the sample is kept from training, one document in so many. A language has a threshold of its own from so many toxic and other texts outside training on.
HELD_OUT = 4
LEAST_HELD_OUT = 5
_PAD = max(WIDTHS) - 1
#: All bits of a hash but the first 20.
_SHIFT = np.uint64(44)


def features(column: pa.Array) -> list[np.ndarray]:
    """For each text the hashes of its words and of their beginnings, a row each."""
    return list(each_word_array(column, stems=STEMS))


class Model:
    """Sorted word hashes, their rows (row 0: all other words), filters, biases, the unit's weights, thresholds by language."""

    def __init__(self, keys, rows, filters, biases, weights, offset):
        self.keys, self.rows, self.filters, self.biases, self.weights, self.offset = keys, rows, filters, biases, weights, offset
        self.thresholds: dict = {None: 2.0}
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """The table of first bits is made anew in each process."""
        return self.__dict__ | {"table": None}

    def places(self, words: np.ndarray) -> np.ndarray:
        """The row of each hash. Most are found, or found to be missing, by their first bits alone; the rest by binary search."""
        if not len(self.keys):
            return np.zeros(words.shape, np.int64)
        if self.table is None:
            bucket = (self.keys >> _SHIFT).astype(np.int64)
            self.table = np.full(1 << (64 - int(_SHIFT)), -1, np.int32)
            self.table[bucket[::-1]] = np.arange(len(self.keys), dtype=np.int32)[::-1]  # the bucket's first key
            self.table[bucket[1:][bucket[1:] == bucket[:-1]]] = -2
        at = self.table[(words >> _SHIFT).astype(np.int64)]
        found = np.where((at >= 0) & (self.keys[at] == words), at + 1, 0).astype(np.int64)
        several = at == -2
        if several.any():
            w = words[several]
            at = np.minimum(np.searchsorted(self.keys, w), len(self.keys) - 1)
            found[several] = np.where(self.keys[at] == w, at + 1, 0)
        return found

    def scores(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        """The probability of each text, given its ``features``, a few texts at a time."""
        out, waiting, size = [np.empty(0)], [], 0
        for t in texts:
            waiting.append(t)
            size += t.shape[1]
            if size > 50_000:
                out.append(self._scores(waiting))
                waiting, size = [], 0
        if waiting:
            out.append(self._scores(waiting))
        return np.concatenate(out)

    def _scores(self, texts: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([t.shape[1] for t in texts])
        begins = np.concatenate([[0], np.cumsum(lengths[:-1] + _PAD)])  # of each text's padding
        ids = np.zeros((1 + len(STEMS), int(lengths.sum()) + _PAD * (len(texts) + 1)), np.int64)
        where = np.arange(int(lengths.sum())) + np.repeat(_PAD * (np.arange(len(texts)) + 1), lengths)
        ids[:, where] = self.places(np.concatenate(texts, axis=1))
        edges = np.append(begins, ids.shape[1])
        sizes = {w: np.diff(np.minimum(edges, ids.shape[1] - w + 1)) for w in WIDTHS}
        e = self.rows[ids[0]]
        for own in ids[1:]:
            e += self.rows[own]
        maxima = []
        for w, bank, bias in zip(WIDTHS, self.filters, self.biases):
            n = ids.shape[1] - w + 1
            total = e[:n] @ bank[0]
            for k in range(1, w):
                total += e[k : n + k] @ bank[k]
            for k in range(TOP):
                best = np.maximum.reduceat(total, begins)
                maxima.append(np.maximum(best + bias[k], 0))
                if k + 1 < TOP:
                    np.putmask(total, total == np.repeat(best, sizes[w], 0), -np.inf)
        z = np.concatenate(maxima, axis=1) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))

    def threshold(self, lang) -> float:
        return self.thresholds.get(lang, self.thresholds[None])


def train(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Model:
    """A model of texts' ``features`` and their labels (0 or 1)."""
    distinct = [np.unique(t) for t in texts]
    pos = np.concatenate([d for d, y in zip(distinct, toxic) if y] or [np.empty(0, np.uint64)])
    every = np.concatenate(distinct or [np.empty(0, np.uint64)])
    del distinct
    every.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
    count = np.diff(np.append(first, len(every)))
    keys, count = every[first[count >= LEAST_TEXTS]], count[count >= LEAST_TEXTS]
    del every, first
    p, c = np.unique(pos, return_counts=True)
    in_toxic = np.zeros(len(keys))
    if len(p) and len(keys):
        at = np.minimum(np.searchsorted(p, keys), len(p) - 1)
        in_toxic = np.where(p[at] == keys, c[at], 0).astype(float)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((count - in_toxic + 0.5) / (n0 + 1))
    rows = np.zeros((len(keys) + 1, DIM), np.float32)
    for d in range(1, DIM):
        rows[1:, d] = (mix(keys + np.uint64(d)) >> np.uint64(40)).astype(np.float32) / (1 << 24) * 0.1 - 0.05
    rows[1:, 0] = odds / ODDS * count / (count + SHRINK)
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for bank in filters:
        bank[:, 0, :] += 1 / bank.shape[0]
    biases = [np.full((TOP, FILTERS), -0.1, np.float32) for _ in WIDTHS]
    weights = np.full(FILTERS * TOP * len(WIDTHS), 0.1, np.float32)
    model = Model(keys, rows, filters, biases, weights, -1.0)
    ids = [np.pad(model.places(t).astype(np.int32), ((0, 0), (_PAD, _PAD))) for t in texts]
    squares = [np.full_like(x, 1e-4) for x in (rows, *filters, *biases, weights)]
    offset_square = 1e-4

    def step(value, square, grad, at=...):
        square[at] += grad * grad
        value[at] -= RATE * grad / np.sqrt(square[at])

    importance = np.where(toxic == 1, 0.5 * len(toxic) / n1, 0.5 * len(toxic) / n0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(ids)):
            e = model.rows[ids[i]].sum(0)
            places, values = [], []
            for w, bank, bias in zip(WIDTHS, model.filters, model.biases):
                n = len(e) - w + 1
                total = e[:n] @ bank[0]
                for k in range(1, w):
                    total += e[k : n + k] @ bank[k]
                at = []
                for k in range(TOP):
                    at.append(total.argmax(0))
                    best = total[at[-1], np.arange(FILTERS)]
                    values.append(best + bias[k])
                    total[total == best] = -np.inf
                places.append(at)
            x = np.concatenate(values)
            live = x > 0
            z = float(np.maximum(x, 0) @ model.weights + model.offset)
            d = (1 / (1 + np.exp(-max(-50.0, min(50.0, z)))) - toxic[i]) * importance[i]
            back = (d * model.weights * live).astype(np.float32)
            step(model.weights, squares[-1], (d * np.maximum(x, 0) + DECAY * model.weights).astype(np.float32))
            offset_square += d * d
            model.offset -= RATE * d / np.sqrt(offset_square)
            for place, at in enumerate(at for ats in places for at in ats):
                g = back[place * FILTERS : (place + 1) * FILTERS]
                if not g.any():
                    continue
                j, nth = divmod(place, TOP)
                w = WIDTHS[j]
                bank = model.filters[j]
                grads = np.stack([e[at + k].T * g for k in range(w)])
                for k in range(w):
                    words = ids[i][:, at + k].ravel()
                    change = np.tile(bank[k].T * g[:, None], (len(ids[i]), 1))
                    real = words > 0
                    if real.any():
                        u, back_to = np.unique(words[real], return_inverse=True)
                        total = np.zeros((len(u), DIM), np.float32)
                        np.add.at(total, back_to, change[real])
                        step(model.rows, squares[0], total, u)
                step(bank, squares[1 + j], grads)
                step(model.biases[j], squares[1 + len(WIDTHS) + j], g, nth)
    return model


def _mark(model: Model, trained: np.ndarray):
    def of(batches):
        for batch in batches:
            scores = model.scores(each_word_array(batch.column(0), stems=STEMS))
            outside = ~np.isin(batch.column(1).to_numpy(zero_copy_only=False), trained)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores), pa.array(outside, pa.bool_())], names=[*batch.schema.names[1:], "score", "outside"])

    return of


def calibrate(model: Model, base: DataFrame, marks: DataFrame, trained: np.ndarray) -> dict:
    """The threshold with the best F1, midway between the scores around it, of each language and (None) of all.

    All rows of ``base`` with a mark count, but those with the doc_ids ``trained``; repeated rows count once. Each kind has the weight of
    all its marked rows. Scores are added up by ranges of log-odds, whose sums alone come to the driver, then within each range.
    """
    m = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    rows = base.join(m, F.col("doc_id").cast("long") == F.col("l_id")).select("text", "l_id", F.xxhash64("text").alias("key"), F.col("lang").cast("string").alias("lang"), "toxic")
    marked = rows.mapInArrow(_mark(model, trained), "l_id long, key long, lang string, toxic int, score double, outside boolean")
    marked = cut(marked.groupBy("l_id", "key").agg(F.min("lang").alias("lang"), F.max("toxic").alias("toxic"), F.max("score").alias("score"), F.max("outside").alias("outside")))
    # by group ("a": all, "l" and a language): of other and toxic rows how many there are, and how many outside training
    total: dict[str, np.ndarray] = {}
    for r in marked.groupBy("lang", "toxic", "outside").count().collect():
        for g in ["a"] + ["l" + r["lang"]] * (r["lang"] is not None):
            total.setdefault(g, np.zeros((2, 2), np.int64))[:, r["toxic"]] += [r["count"], r["count"] * r["outside"]]
    own = {g: t for g, t in total.items() if t[1].min() >= (1 if g == "a" else LEAST_HELD_OUT)}
    spark = base.sparkSession
    weights = spark.createDataFrame([(g, *(t[0] / t[1]).tolist(), int(t[0, 1])) for g, t in own.items()], "g string, other double, toxic double, all_toxic long")
    group = F.explode(F.array_compact(F.array(F.lit("a"), F.concat(F.lit("l"), "lang")))).alias("g")
    by_score = marked.where("outside").select(group, "score", "toxic").groupBy("g", "score").agg(F.sum("toxic").alias("hit"), F.count(F.lit(1)).alias("n"))
    odds = F.coalesce(F.log(F.try_divide("score", 1 - F.col("score"))), F.lit(50.0))
    by_score = cut(by_score.join(F.broadcast(weights.select("g")), "g").withColumn("range", F.floor(10 * odds)))
    before, sums = [], {}
    for r in by_score.groupBy("g", "range").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).orderBy("g", F.desc("range")).collect():
        hit, n = sums.get(r["g"], (0, 0))
        before.append((r["g"], r["range"], hit, n))
        sums[r["g"]] = (hit + r["hit"], n + r["n"])
    before = spark.createDataFrame(before, "g string, range long, hit_before long, n_before long")
    w = Window.partitionBy("g", "range").orderBy(F.desc("score"))
    hits = F.col("hit_before") + F.sum("hit").over(w)
    summed = by_score.join(F.broadcast(before), ["g", "range"]).select("g", "score", hits.alias("hits"), (F.col("n_before") + F.sum("n").over(w) - hits).alias("others")).join(F.broadcast(weights), "g")
    found = F.col("hits") * F.col("toxic")
    f1 = 2 * found / (found + F.col("others") * F.col("other") + F.col("all_toxic"))
    best = summed.groupBy("g").agg(F.max(F.struct(f1.alias("f1"), "score"))["score"].alias("best")).collect()
    best = spark.createDataFrame([(r["g"], r["best"]) for r in best], "g string, best double")
    ends = by_score.join(F.broadcast(best), "g").groupBy("g", "best").agg(F.coalesce(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))), F.lit(0.0)).alias("next"))
    return {None if r["g"] == "a" else r["g"][1:]: (r["best"] + r["next"]) / 2 for r in ends.collect()}


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Model:
    """A model from the bounded sample of labelled documents, thresholds from all others; without toxic or other labels it rejects nothing.

    Of several texts with one sampled doc_id the least one trains; those of a trained doc_id don't count for thresholds.
    """
    marks = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    by_hash = F.xxhash64(F.col("l_id"))
    sample = marks.where("toxic = 1").orderBy(by_hash, "l_id").limit(toxic_rows).unionByName(marks.where("toxic = 0").orderBy(by_hash, "l_id").limit(other_rows))
    base = pick(docs, "doc_id", "text", "lang").where("text IS NOT NULL")
    own = base.join(F.broadcast(sample), F.col("doc_id").cast("long") == F.col("l_id")).groupBy("l_id", "toxic").agg(F.min("text").alias("text"))
    rows = own.toPandas().sort_values("l_id")  # the sample's bound bounds this: one text for each of its ids, however many rows have the id
    y = rows["toxic"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.uint64), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros((TOP, FILTERS), np.float32) for _ in WIDTHS], np.zeros(FILTERS * TOP * len(WIDTHS), np.float32), -1.0)
    texts = features(pa.array(rows["text"], pa.string()))
    held = (mix(rows["l_id"].to_numpy(np.int64).view(np.uint64) + np.uint64(11)) >> np.uint64(33)) % np.uint64(HELD_OUT) == 0
    if y[held].min(initial=1) == y[held].max(initial=0) or y[~held].min(initial=1) == y[~held].max(initial=0) or held.sum() < 2 * LEAST_HELD_OUT:
        held = np.zeros(len(y), bool)
    model = train([t for t, h in zip(texts, held) if not h], y[~held])
    trained = rows["l_id"].to_numpy(np.int64)[~held] if held.any() else np.empty(0, np.int64)
    model.thresholds |= calibrate(model, base, marks, trained)
    return model


def _score(model: Model):
    def of(batches):
        for batch in batches:
            scores = model.scores(each_word_array(batch.column(0), stems=STEMS))
            cut = np.array([model.threshold(x) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(scores), pa.array(cut, pa.float64()), pa.array(scores >= cut if len(cut) else [], pa.bool_()), *batch.columns], names=["score", "threshold", "toxic", *batch.schema.names])

    return of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic), one row for each row of ``docs``, in one pass.

    Null and empty texts are scored as texts without words. A null or unknown lang has the threshold over all languages. Null and
    repeated doc_ids pass through; further columns are dropped; an empty table gives an empty result.
    """
    base = pick(docs, "doc_id", "text", "lang").select(F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"))
    return base.mapInArrow(_score(model), "score double, threshold double, toxic boolean, text string, lang string, doc_id long").select("doc_id", "lang", "score", "threshold", "toxic")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below their language's threshold."""
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text, lang = f"_{names.index('text')}", f"_{names.index('lang')}"
    types = dict(plain.dtypes)
    schema = "score double, threshold double, toxic boolean, text string, lang string, " + ", ".join(f"{c} {types[c]}" for c in plain.columns)
    scored = plain.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), *plain.columns).mapInArrow(_score(model), schema)
    return scored.where("NOT toxic").select(plain.columns).toDF(*names)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
