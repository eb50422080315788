import time

from xylem.functions.values import decoded
from xylem.sources.markup import decode

TEXTS = ["", "&", "&&amp;lt;&#38;lt;", "&amp;lt;", "&amp;#65;", "&#65;&#x42;&lt", "&a&quot;mp;", "&#55555;&#xD800;&#1114112;&#999999999999;x", "&#x1F600;é&apos;&gt;", "&lt;&#60;" * 3, "&#;&#x;&amp", "&amp;amp;&lt;&gt;"]


def test_decoded_as_the_parser_does(spark):
    rows = spark.createDataFrame([(x,) for x in [*TEXTS, None]], "x string")
    for x, have in rows.select("x", decoded(rows.x)).collect():
        assert have == (None if x is None else decode(x)), x


def test_time_grows_with_the_text(spark):
    """20,000 entities in a text took 20,000 searches of it."""
    texts = ["a&#65;" * 20_000, "b&lt;" * 20_000]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    began = time.time()
    assert [r[0] for r in rows.select(decoded(rows.x)).collect()] == [decode(x) for x in texts]
    assert time.time() - began < 60
