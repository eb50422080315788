"""Documents read many at once give the rows that reading them one by one gives."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from xylem.sources import markup, plain, relational, store

PIECES = ["<a>", "</a>", "<b x='1' y=\"2&amp;\">", "</b>", "<c/>", "<c k='é'/>", "t", "é&lt;u", "&#65;", " ", "<!--k-->", "<!---->", "<!-- > -->", "<![CDATA[d&amp;]]>", "<![CDATA[]]>", "<?pi x y?>", "<?xml version='1'?>", "<!DOCTYPE a>", ">", "<", "<d q='>'>", "<d q=\"<\">", "<e xml:lang='de'>", "<x:y>", "</>", "<>", "'", "日本", "<f a=b>", "<!-->", "<?>", "<g/ >"]
OFTEN = [6, 8, 5, 6, 3, 3, 6, 3, 2, 4, 2, 1, 0.3, 2, 1, 1, 1, 0.6, 0.2, 0.1, 0.2, 0.2, 0.2, 0.1, 0.3, 0.2, 0.3, 2, 0.5, 0.1, 0.1, 0.1]


def _one_by_one(ids, texts, columns, names):
    rows = markup._Rows(columns, names)
    for i, x in zip(ids, texts):
        rows.add(int(i), markup.Tree(x))
    return rows.batch()


@pytest.mark.parametrize("names", [None, frozenset(["a", "c"])])
@pytest.mark.parametrize("columns", [markup.COLUMNS, ["pre", "value"]])
def test_the_same_rows(columns, names):
    rng, n_plain = random.Random(1), 0
    for _ in range(300):
        texts = ["".join(rng.choices(PIECES, OFTEN, k=rng.choice([0, 1, 3, 8, 20]))) for _ in range(rng.choice([1, 3, 12]))]
        ids = np.arange(len(texts)) + 5
        made, others = plain.nodes(ids, pa.array(["cut", *texts], pa.string())[1:], columns, names, markup.plain_tag, markup._column_of_lists)
        good = np.setdiff1d(np.arange(len(texts)), others)
        n_plain += len(good)
        made.validate(full=True)
        assert made.equals(_one_by_one(ids[good], [texts[k] for k in good], columns, names))
    assert n_plain > 500


def test_documents_of_records_are_read_together(spark):
    """No order document is read one by one, which took five times as long."""
    docs = relational.documents(spark, "/root/testdata/sf0.001", "order").limit(300).toPandas()
    made, others = plain.nodes(docs["doc_id"].to_numpy(), pa.array(docs["xml"], pa.string()), markup.COLUMNS, None, markup.plain_tag, markup._column_of_lists)
    assert not len(others) and made.num_rows > 300


def test_large_texts_leave_in_small_batches():
    """Few nodes with long texts are as much as many with short ones."""
    text = "<d xml:lang='en'><b>" + "x" * 100_000 + "</b></d>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([text] * 200)], names=["doc_id", "xml"])
    sizes = [x.nbytes for x in markup._nodes(iter([batch]), markup.COLUMNS, None)]
    assert len(sizes) > 10 and max(sizes) < 8_000_000


def test_stored_files_are_the_tasks_own(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.format_string("<a n='%d'><b>t&amp;</b></a>", "id").alias("xml")).repartition(3)
    frame = store.write(docs, f"file://{tmp_path}/s")
    left = os.listdir(tmp_path / "s" / "nodes")
    assert left and all(x.startswith(("part-", ".part-")) for x in left)
    assert len(glob.glob(f"{tmp_path}/s/nodes/part-*")) <= 3
    have, want = (x.select("doc_id", "pre", *[c for c in markup.COLUMNS if c != "pre"]) for x in (frame.nodes(), markup.parse(docs)))
    assert sorted(map(repr, have.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(Exception):
        store.write(docs, f"file://{tmp_path}/s")
    none = store.write(docs.limit(0), f"file://{tmp_path}/none")
    assert none.nodes().count() == 0


def test_tag_names_of_ascii_and_other_texts(spark):
    texts = ["<a><b-1 x='<c>'/></a>", "<é><b x/>", "<!x><?y?></z><q\x1cr>"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(markup.tag_names("x")).collect()
    assert [r[0] for r in rows] == [["a", "b-1", "c"], ["é", "b"], ["q"]]
