import io
import json
import sys

from xylem.__main__ import main


def call(spark, *argv):
    out = io.StringIO()
    return main(list(argv), out, spark), out.getvalue()


def test_command_line(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><a x='1'>one &amp; two</a><a> </a></r>")
    (tmp_path / "b.xml").write_text("<r><b/></r>")
    a, b = (f"file:{tmp_path}/{n}.xml" for n in "ab")
    assert call(spark, "//a", a) == (0, "one & two\n")
    assert call(spark, "-W", "-0", "//a", a) == (0, "one & two\0 \0")
    assert call(spark, "-c", "//a", a, b) == (0, f"{a}:2\n{b}:0\n")
    assert call(spark, "-H", "-c", "//a", a, b) == (0, "2\n0\n")
    assert call(spark, "-l", "//a", a, b) == (0, f"{a}\n")
    assert call(spark, "-r", "//a[1]", a) == (0, "<a x='1'>one &amp; two</a>\n")
    code, text = call(spark, "-j", "//a/@x", a)
    assert code == 0 and json.loads(text) == ["1"]
    assert call(spark, "count(//a)", a) == (0, "2\n")
    assert call(spark, "//nothing", a)[0] == 1 and call(spark, "//[", a)[0] == 2 and call(spark, "//a", f"file:{tmp_path}/missing.xml")[0] == 2
    assert call(spark, "info", a)[1].splitlines()[:5] == ["tags 3", "texts 2", "max depth 1", "bytes 41", "unique tags 2"]


def test_standard_input(spark, monkeypatch):
    for argv in (["//a"], ["//a", "-"], ["-c", "//a"]):
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO("<r><a>é</a></r>".encode()), "utf-8"))
        assert call(spark, *argv) == (0, "1\n" if argv[0] == "-c" else "é\n")
