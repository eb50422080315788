"""Expressions with the results that a public conformance suite gives, and the node-sets that it settles."""

import pytest

from xylem.functions import interp
from xylem.functions.interp import compiled
from xylem.operators.frame import XmlFrame
from xylem.plans import catalog
from xylem.plans import grammar as g


def test_expressions():
    cases = catalog.expressions()
    assert len(cases) > 230
    for expr, kind, want in cases:
        _, got = interp.evaluate("<r/>", expr, "root")
        have = {"number": lambda x: catalog.six_digits(x), "boolean": lambda x: str(x).lower(), "string": str}[kind](got)
        assert (g.kind(compiled(expr)), have) == (kind, want), expr
    assert interp.evaluate("<r/>", "+".join(["1*1"] * 21))[1] == 21
    with pytest.raises(g.XPathError):
        compiled("self::-name")


LANG = "<d><x/><b xml:lang='en'><x/><x/></b><p xml:lang='EN-us'/><q xml:lang='fr'><p/></q><z xml:lang=''/></d>"
NS = "<d xmlns:k='u1'><before/><e xmlns:l='u2'/><after/></d>"
KINDS = "<?xml version='1.0'?><r><f>t<!--c--><![CDATA[d]]><?pi x?><g>t<!--c--><![CDATA[d]]><?pi x?></g></f></r>\n"
REGIONS = "<r><s p='r'/><p1><s p='1'/></p1><p2><s p='2'/></p2></r>"


@pytest.mark.parametrize(
    "xml,xpath,n",
    [
        (LANG, "//*[lang('')]", 0), (LANG, "//*[lang('en')]", 4), (LANG, "//*[lang('en-US')]", 1), (LANG, "//*[lang('fr')]", 2),
        (NS, "/d/e/namespace::*/self::node()[true()]", 3), (NS, "/d/e/namespace::node()/..", 1), (NS, "//*[namespace::k]", 4), (NS, "/d/e/namespace::l/following::*", 1), (NS, "/d/e/namespace::l/preceding::*", 1), (NS, "//namespace::xml", 4),
        (KINDS, "/.", 1), (KINDS, "//.", 12), (KINDS, "/r//.", 11), (KINDS, "//.//./././/.", 12), (KINDS, "/r//././/g//.", 5), (KINDS, "//processing-instruction()", 2),
        (REGIONS, "//s", 3), (REGIONS, "//s | p1", 3), (REGIONS, "//s | /r/p1/s", 3), (REGIONS, "/r/p1/s | //p2", 2),
    ],
)
def test_node_sets(spark, xml, xpath, n):
    got = interp.evaluate(xml, xpath, "root")[1]
    assert len(got) == n
    docs = spark.createDataFrame([(1, xml)], "doc_id long, xml string")
    assert XmlFrame(docs).xpath(xpath, "root").count() == n
