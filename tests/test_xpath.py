"""XPath: hand-made cases, and the relational plans against the whole-document evaluator."""

import math
import random

import pytest

from xylem.functions import interp
from xylem.functions import values as v
from xylem.operators.frame import XmlFrame, distinct_docs, needed_names
from xylem.plans import grammar as g
from xylem.plans.compile import Plan, compiled
from xylem.sources import markup

BOOK = (
    "<?xml version='1.0'?><!DOCTYPE shelf [<!ELEMENT book ANY>]><shelf xml:lang='en' xmlns:m='urn:m'>"
    "<book id='b1' price='12'><title>Alpha &amp; Omega</title><m:note kind='x'>one</m:note></book>"
    "<!-- gap --><book id='b2' price='7' xml:lang='de-AT'><title>Beta</title><tag/><tag>t<![CDATA[<raw>]]></tag></book>"
    "<?sort by title?><book id='b3'><title>Gamma</title>tail</book></shelf>"
)
DOCS = [(1, BOOK), (2, "<r><a>5<a>6</a></a><b>1</b><b y='2'>-1.5</b></r>"), (3, None), (4, ""), (5, "<p>a<br>b&amp;c<p>d</p>"), (6, "</x><r>u</y>v<z"), (7, "plain")]


def names(xpath, xml=BOOK, context="root"):
    e, got = interp.evaluate(xml, xpath, context)
    return [e.name(n) or e.value(n) for n in got] if isinstance(got, list) else got


@pytest.mark.parametrize(
    "xpath, want",
    [
        ("//book/title/text()", ["Alpha & Omega", "Beta", "Gamma"]),
        ("//book[2]/@price", ["price"]),
        ("count(//book)", 3.0),
        ("//book[last()]/title", ["title"]),
        ("string(//tag[2])", "t<raw>"),
        ("count(//tag[2]/text())", 2.0),
        ("name(//tag[1]/..)", "book"),
        ("//comment()", [" gap "]),
        ("/shelf/processing-instruction()", ["sort"]),
        ("string(/shelf/processing-instruction('sort'))", "by title"),
        ("namespace-uri(//m:note)", "urn:m"),
        ("//m:*/@kind", ["kind"]),
        ("count(//book[lang('de')])", 1.0),
        ("count(//title[lang('EN')])", 2.0),
        ("sum(//@price)", 19.0),
        ("sum(//book/@price | //book[3])", math.nan),
        ("//book[@price > 10]/@id", ["id"]),
        ("//book[not(@price)]/title", ["title"]),
        ("id('b3 b1')/title/text()", ["Alpha & Omega", "Gamma"]),
        ("//title[. = 'Beta']/ancestor::*", ["shelf", "book"]),
        ("//title[. = 'Beta']/ancestor::*[1]", ["book"]),
        ("//book[3]/preceding-sibling::book[1]/@id = 'b2'", True),
        ("(//book)[3]/preceding::title[1] = 'Beta'", True),
        ("count(//tag[1]/following::node())", 8.0),
        ("//book[title][2]/@id = 'b2'", True),
        ("//book['']", []),
        ("//tag | //title | //tag", ["title", "title", "tag", "tag", "title"]),
        ("count(/shelf/namespace::*)", 2.0),
        ("boolean(//nothing)", False),
        ("3 mod -2", 1.0),
        ("-3 mod 2", -1.0),
        ("1 div 0", math.inf),
        ("1 div -0", -math.inf),
        ("round(-2.5)", -2.0),
        ("round(2.5)", 3.0),
        ("floor(-1.5) + ceiling(-1.5)", -3.0),
        ("substring('12345', 1.5, 2.6)", "234"),
        ("substring('12345', 0 div 0, 3)", ""),
        ("substring('12345', -42, 1 div 0)", "12345"),
        ("substring('12345', -1 div 0, 1 div 0)", ""),
        ("substring-before('a-b-c', '-')", "a"),
        ("substring-after('a-b-c', '-')", "b-c"),
        ("substring-after('abc', 'x')", ""),
        ("normalize-space(' a \n  b ')", "a b"),
        ("translate('bar', 'abc', 'AB')", "BAr"),
        ("string-length('héé')", 3.0),
        ("concat(1 div 3, ' ', 1e15, ' ', 0.5, ' ', -0)", "0.333333333333333 1e+15 0.5 0"),
        ("string(0 div 0)", "NaN"),
        ("'1' = 1.0 and true() = 'x' and not(0 div 0 = 0 div 0)", True),
        ("number('  -1.50 ')", -1.5),
        ("number('+1') = number('+1')", False),
        ("number('1e3')", math.nan),
    ],
)
def test_evaluator(xpath, want):
    got = names(xpath)
    assert got == want or isinstance(want, float) and math.isnan(want) and math.isnan(got)


@pytest.mark.parametrize("bad", ["//a[", "a b", "count()", "count('x')", "nothing(1)", "substring('a')", "1 | 2", "foo::a", "$x", "//", "'a'/b"])
def test_errors(bad):
    with pytest.raises(g.XPathError):
        g.parse(bad)


def test_parser_rules():
    t = markup.Tree("<a>x</b>y<c>z")  # names of end tags don't matter; text after the last tag is dropped
    assert [(k, n) for k, n in zip(t.kind, t.name)] == [("root", None), ("element", "a"), ("text", None), ("element", "c")]
    assert t.parent == [None, 0, 1, 0] and t.end == [3, 2, 2, 3]
    t = markup.Tree("<a p = 'no' q=\"1>2\" r='&#65;&#x42;&lt;&nope;'/>")
    assert t.attrs[1] == [("q", "1>2", None), ("r", "AB<&nope;", None)]
    assert markup.Tree("<a><b").error and markup.Tree("<a x='1>").error and markup.Tree("<").error
    assert markup.Tree("<a><!-- open").text[2] == " open" and markup.Tree("<a><![CDATA[x").text[2] == "x"
    deep = markup.Tree("<d>" * 5000 + "</d>" * 5000)
    assert max(deep.depth) == 5000 and deep.end[1] == 5000
    assert markup.decode("&#xD800;&#1114112;&#99999999999;&amp;lt;") == "&lt;"


QUERIES = """//a|/r/a|//a[2]|//b[last()]|//book/@*|//book[@price]|//book[not(@price)]|//b/ancestor::*|//title/ancestor::*[1]|//b/preceding::a|//tag/following::node()
//tag/preceding-sibling::node()[1]|//text()|//comment()|//processing-instruction('sort')|//m:note|/shelf/namespace::*|count(//a) + 1|sum(//b)|string(//a[2])|//a[. > 1]
//a[position() > 1][1]|(//b)[2]|id('b2')/following-sibling::book|//*[count(*) > 1]|//title[contains(., 'a')]|namespace-uri(//m:note)|//title[lang('de')]|//b[. = //a]|//b[. != //a]
//a[. < //b]|//b[. < //a]|boolean(//tag)|1 div -0|substring('12345', 2, 3)|string(1 div 3)|string(-1e20)|//a = 6|//title = 'Beta'|//a[../b]|..|.|/|//a[.//a]|//book[tag or @price = 12]
//@price/..|//@price/ancestor::*|//@id/following::title|//a/descendant-or-self::node()/@*|/shelf[book/@price = book/title]|//*[2]|//node()[1]|//book[@price = count(tag) + 5]
name(//@*)|//book[string-length(title) = 4]|//p[br]|string(//p)|//book[tag][1]/title|translate(name(/*), 'r', 'R')|//book[2][tag]|//*[self::a or self::b]""".replace("\n", "|")


def test_relational_plans_agree_with_the_evaluator(spark):
    nodes = markup.parse(spark.createDataFrame(DOCS, "doc_id long, xml string")).persist()
    for xpath in QUERIES.split("|"):
        check(nodes, DOCS, xpath)
    nodes.unpersist()


def check(nodes, docs, xpath, context="root"):
    e, want = compiled(xpath), {}
    for i, x in docs:
        if x is not None:
            ev, got = interp.evaluate(x, xpath, context)
            want[i] = sorted((n[0], n[1], ev.kind(n), ev.name(n), ev.value(n)) for n in got) if isinstance(got, list) else repr(got)
    plan = Plan(nodes, context)
    if g.kind(e) == g.NODESET:
        have = {i: [] for i in want}
        for r in plan.top(e).select("doc_id", "pre", "aord", "kind", "name", "value").collect():
            have[r[0]].append((r[1], r[2], r[3], r[4] or "", r[5] or ""))
        have = {i: sorted(x) for i, x in have.items()}
    else:
        have = {r[0]: repr(r[1]) for r in plan.value(e).collect()}
    assert have == want, xpath


def _random_path(rng, depth=0):
    axes = ["child", "descendant", "parent", "ancestor", "following-sibling", "preceding-sibling", "following", "preceding", "self", "descendant-or-self", "ancestor-or-self", "attribute"]
    steps = []
    for _ in range(rng.randint(1, 2)):
        test = rng.choice(["a", "b", "*", "node()", "text()"])
        p = ""
        if depth < 2 and rng.random() < 0.4:
            inner = _random_path(rng, 2)
            p = "[" + rng.choice(["1", "last()", "position() > 1", "@x", inner, f"not({inner})", f"count({inner}) = 1", f". = {inner}", f"{inner} > 1"]) + "]"
        steps.append(f"{rng.choice(axes)}::{test}{p}")
    return "/".join(steps)


def _random_xml(rng, depth=0):
    name = rng.choice("ab")
    inside = "".join(rng.choice([_random_xml(rng, depth + 1) if depth < 3 else "", str(rng.randint(0, 3)), ""]) for _ in range(rng.randint(0, 4)))
    return f"<{name}{rng.choice(['', ' x=%s1%s' % (chr(39), chr(39))])}>{inside}</{name}>"


def test_random_paths_over_random_documents(spark):
    rng = random.Random(5)
    docs = [(i, _random_xml(rng)) for i in range(12)]
    nodes = markup.parse(spark.createDataFrame(docs, "doc_id long, xml string")).persist()
    for _ in range(25):
        check(nodes, docs, "/descendant::*/" + _random_path(rng))
    nodes.unpersist()


def test_pruned_parsing_changes_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, xml string")
    for xpath in ("//book[tag]/title", "//a/b", "/r/a/a", "//book[@price > 10]/title", "//title | //b"):
        assert needed_names(compiled(xpath))
        assert sorted(XmlFrame(docs).xpath_string(xpath, "root").collect()) == sorted(XmlFrame(docs, prune=False).xpath_string(xpath, "root").collect())
    assert needed_names(compiled("//a/..")) is None and needed_names(compiled("//*")) is None


def test_outputs(spark):
    f = XmlFrame(spark.createDataFrame(DOCS, "doc_id long, xml string"))
    assert sorted((r.doc_id, r.text) for r in f.xpath_text("//title", "root").collect()) == [(1, "Alpha &amp; Omega"), (1, "Beta"), (1, "Gamma")]
    assert {r.raw for r in f.xpath_raw("//tag | //book/@id", "root").collect()} == {"<tag/>", "<tag>t<![CDATA[<raw>]]></tag>", "b1", "b2", "b3"}
    assert {r.doc_id: r.texts for r in f.batch_text("//b").collect()} == {1: [], 2: ["1", "-1.5"], 3: [], 4: [], 5: [], 6: [], 7: []}
    assert {r.doc_id: r.n for r in f.count_batch("//title").collect()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert [r.doc_id for r in f.matching("//title").collect()] == [1]
    assert [r.json for r in f.json("//book/@id").collect()] == ['{"matches":["b1","b2","b3"]}']
    assert {r.doc_id: r.value for r in f.display("//b", "root").collect()}[2] == "1\n-1.5"
    assert [tuple(r) for r in f.info(2).collect()] == [("book", 3), ("title", 3)]
    s = {r.doc_id: r for r in f.summary().collect()}
    assert (s[1].n_tags, s[1].max_depth, s[4].n_tags, 3 in s) == (12, 2, 0, False)
    t = {(r.doc_id, r.pre): r for r in f.texts_of("//title").collect()}
    assert [r.tail for r in t.values() if r.text == "Gamma"] == ["tail"]
    assert [(r.name, r.value) for r in f.attributes("//m:note").collect()] == [("kind", "x")]
    assert [r.xml for r in f.canonical("//tag").collect()] == ["<tag></tag>", "<tag>t&lt;raw&gt;</tag>"]
    assert {r.error is not None for r in markup.parse_errors(f.docs).collect()} == {True}


def test_relative_paths_start_at_the_document_element(spark):
    f = XmlFrame(spark.createDataFrame(DOCS, "doc_id long, xml string"))
    assert [r.value for r in f.xpath_string("book[1]/title").collect()] == ["Alpha & Omega"]
    assert f.xpath_string("book[1]/title", "root").collect() == []
    assert {r.doc_id: r.value for r in f.eval("count(b)").collect()}[2] == 2.0


def test_hostile_tables(spark):
    """Empty tables, repeated rows, null ids, and columns that clash."""
    empty = spark.createDataFrame([], "doc_id long, xml string")
    assert XmlFrame(empty).xpath("//a").collect() == [] and XmlFrame(empty).count_batch("//a").collect() == []
    docs = spark.createDataFrame([(1, "<a/>", 1, "x"), (1, "<a/>", 2, "y"), (None, "<a/>", 3, "z")], "doc_id long, xml string, pre int, XML string")
    one = distinct_docs(docs)
    assert sorted((r.doc_id is None, r.n) for r in XmlFrame(one).count_batch("//a").collect()) == [(False, 1), (True, 0)]
    assert one.count() == 2
    long = "<r>" + "<a>word </a>" * 100_000 + "</r>"
    assert XmlFrame(spark.createDataFrame([(1, long)], "doc_id long, xml string")).xpath("//a[last()]", "root").collect()[0].pre == 200_000


def test_column_functions_agree_with_scalar_ones(spark):
    from pyspark.sql import functions as F

    numbers = [0.0, -0.0, 1.5, -2.5, 2.5, 1 / 3, 1e15, 123456.789, 1e-5, 1e300, math.inf, -math.inf, math.nan, 0.1, 1e21, -1e-7, 999999999999999.9]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", v.number_text(F.col("x")).alias("s"), v.rounded(F.col("x")).alias("r")).collect()
    for r in rows:
        assert r.s == v.format_number(r.x), r
        assert repr(r.r).replace("-0.0", "0.0") == repr(v.round_half_up(r.x)).replace("-0.0", "0.0")
    texts = ["a&amp;b", "&#65;&#x1F600;&lt;", "&nope; &#55296;", None, "", "&#xZZ;", "a & b &quot;"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", v.decoded(F.col("t")).alias("d")).collect():
        assert r.d == (None if r.t is None else markup.decode(r.t))
