import random

import numpy as np
import pyarrow as pa

from xylem.llm import toxicity as t

from .conftest import NO_DOCS, hostile, word


def labelled(n=600, seed=3):
    """Texts in two languages, toxic ones with a few words of a small set, and their labels."""
    rng = random.Random(seed)
    bad = [word(random.Random(100 + k)) + "x" for k in range(12)]
    vocabulary = [word(rng) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words), rng.choice(["en", "de"])))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = t.fit(df, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    assert {"en", "de"} <= set(model.thresholds)
    got = {r.doc_id: r for r in t.score(df, model).collect()}
    truth = dict(labels)
    unseen = range(400, 600)
    assert np.mean([got[i].toxic == bool(truth[i]) for i in unseen]) > 0.97
    kept = {r.doc_id for r in t.keep_clean(df, model).collect()}
    assert kept == {i for i in got if not got[i].toxic}


def test_thresholds_come_from_all_documents_outside_training(spark, monkeypatch):
    docs, labels = labelled(900)
    flip = random.Random(5)
    labels = [(i, y ^ (flip.random() < 0.1)) for i, y in labels]
    trained, train = [], t.train
    monkeypatch.setattr(t, "train", lambda texts, toxic: trained.extend(x.tobytes() for x in texts) or train(texts, toxic))
    model = t.fit(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), 120, 80)
    found = t.features(pa.array([x[1] for x in docs]))
    outside = np.array([x.tobytes() not in set(trained) for x in found])
    scores, y, langs = model.scores(found), np.array([y for _, y in labels]), np.array([x[2] for x in docs])
    assert len(trained) <= 200 < outside.sum()
    for lang in (None, "de", "en"):
        own = langs == lang if lang else np.ones(len(y), bool)
        weight = [(own & (y == k)).sum() / (own & outside & (y == k)).sum() for k in (0, 1)]
        s, toxic = scores[own & outside], y[own & outside]
        f1 = {}
        for at in s:
            hit, wrong = ((s >= at) & (toxic == 1)).sum() * weight[1], ((s >= at) & (toxic == 0)).sum() * weight[0]
            f1[at] = 2 * hit / (hit + wrong + (own & (y == 1)).sum())
        best = max(f1, key=f1.get)
        assert np.isclose(model.thresholds[lang], (best + max(s[s < best - 1e-9], default=0)) / 2, atol=1e-4)


def test_long_texts_are_scored_to_their_end():
    docs, labels = labelled()
    found = t.features(pa.array([x[1] for x in docs]))
    model = t.train(found, np.array([y for _, y in labels]))
    toxic, clean = (next(f for f, (_, y) in zip(found, labels) if y == k) for k in (1, 0))
    alone, filler = model.scores([toxic])[0], np.concatenate([clean] * 3000, axis=1)
    assert model.scores([np.concatenate([filler, toxic], axis=1)])[0] >= alone - 0.2 > model.scores([filler])[0]


def test_scores_by_hand():
    """The convolution and pooling of a text, and of several at once, written out."""
    docs, labels = labelled(200)
    found = t.features(pa.array([x[1] for x in docs] + ["", "one"]))
    model = t.train(found[:-2], np.array([y for _, y in labels]))
    want = []
    for f in found:
        ids = np.pad(model.places(f), ((0, 0), (2, 2)))
        e, x = model.rows[ids].sum(0), []
        for w, bank, bias in zip(t.WIDTHS, model.filters, model.biases):
            values = np.array([[(e[i : i + w] * bank[:, :, k]).sum() for k in range(t.FILTERS)] for i in range(len(e) - w + 1)])
            for n in range(t.TOP):
                x += [max(0.0, (sorted({round(float(u), 5) for u in values[:, k]}, reverse=True) + [-9e9] * t.TOP)[n] + bias[n, k]) for k in range(t.FILTERS)]
        want.append(1 / (1 + np.exp(-(np.array(x) @ model.weights + model.offset))))
    assert np.allclose(model.scores(found), want, atol=1e-2)
    assert np.allclose(model.scores(found), [model.scores([f])[0] for f in found], atol=1e-5)


def test_one_kind_of_labels_rejects_nothing(spark):
    docs, labels = labelled(60)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for given in ([(i, 0) for i, _ in labels], [(i, None) for i, _ in labels], [(None, 1)]):
        model = t.fit(df, spark.createDataFrame(given, "doc_id long, toxic int"))
        assert t.keep_clean(df, model).count() == 60


def test_one_text_of_each_id_trains(spark):
    docs, labels = labelled(200)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    more = [*docs, *docs[:50] * 3, *[(i, text + " zz", lang) for i, text, lang in docs[:20]]]
    a, b = (t.fit(spark.createDataFrame(x, "doc_id long, text string, lang string"), marks) for x in (docs, more))
    assert np.array_equal(a.rows, b.rows) and np.array_equal(a.weights, b.weights)


def test_hostile_tables(spark):
    docs = hostile(spark)
    train_docs, labels = labelled(200)
    model = t.fit(spark.createDataFrame(train_docs, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (1, None), (None, 1), (1, 0)], "doc_id long, toxic int"))
    got = t.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.threshold for r in got if r.lang in (None, "xx", "fr")} == {model.thresholds[None]}
    kept = t.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    assert t.score(spark.createDataFrame([], NO_DOCS), model).collect() == []
