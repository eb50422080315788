"""Command line: XPath over files.

    python -m xylem [-c | -l | -r | -j] [-0] [-W] [-H] [-t N] XPATH [FILE...]
    python -m xylem info [FILE...]

Exit codes: 0 something was found, 1 nothing, 2 an error. Folders and patterns are read by all tasks in parallel.
Without files, or for the file ``-``, the document comes from standard input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.operators.frame import XmlFrame
from xylem.plans import grammar as g
from xylem.plans.compile import compiled
from xylem.sources import files


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="xylem", description="XPath 1.0 over XML files")
    how = p.add_mutually_exclusive_group()
    how.add_argument("-c", "--count", action="store_true", help="print the number of matches")
    how.add_argument("-l", "--files-with-matches", action="store_true", help="print names of files with matches")
    how.add_argument("-r", "--raw", action="store_true", help="print the pieces of XML that match")
    how.add_argument("-j", "--json", action="store_true", help="print one JSON array")
    p.add_argument("-0", "--null", action="store_true", help="end each result with a null character")
    p.add_argument("-W", "--keep-whitespace", action="store_true", help="also print results of white space alone")
    p.add_argument("-H", "--no-filename", action="store_true", help="no file names in front of results")
    p.add_argument("-t", "--threads", type=int, default=0, help="local threads; all by default")
    p.add_argument("xpath", help="expression, or info for statistics")
    p.add_argument("paths", nargs="*", help="files, folders or patterns; - or none: standard input")
    return p.parse_args(argv)


def documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(doc_id, uri, xml) of the files, and of standard input, read once, which is one document called ``-``."""
    paths = [x for x in a.paths if x != "-"]
    found = [files.read_files(spark, *paths)] if paths else []
    if len(paths) < len(a.paths) or not a.paths:
        if getattr(a, "stdin", None) is None:
            raw = getattr(sys.stdin, "buffer", sys.stdin).read()
            a.stdin = raw if isinstance(raw, str) else raw.decode("utf-8", "replace")
        found.append(spark.createDataFrame([("-", a.stdin)], "uri string, xml string").select(F.xxhash64("uri").alias("doc_id"), "uri", "xml"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def results(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(uri, pre, aord, value) in no particular order; for scalars one row a file."""
    docs = documents(spark, a)
    frame = XmlFrame(docs)
    e = compiled(a.xpath)
    if g.kind(e) != g.NODESET:
        found = frame.display(a.xpath).select("doc_id", F.lit(0).alias("pre"), F.lit(0).alias("aord"), "value")
    elif a.raw:
        found = frame.xpath_raw(a.xpath).withColumnRenamed("raw", "value")
    else:
        found = frame.xpath_string(a.xpath).select("doc_id", "pre", "aord", "value")
    names = docs.select("doc_id", "uri")
    return names.join(found, "doc_id").select("uri", "pre", "aord", "value")


def run(spark: SparkSession, a: argparse.Namespace, out) -> int:
    end = "\0" if a.null else "\n"
    many = documents(spark, a).select("uri").limit(2).count() > 1 and not a.no_filename
    if a.xpath == "info":
        docs = documents(spark, a)
        frame = XmlFrame(docs)
        total = frame.totals().first()
        size = docs.agg(F.coalesce(F.sum(F.octet_length("xml")), F.lit(0))).first()[0]
        out.write(f"tags {total['tags']}\ntexts {total['texts']}\nmax depth {total['max_depth']}\nbytes {size}\nunique tags {total['unique_tags']}\n")
        for r in frame.info().collect():
            out.write(f"{r['n']:>10} {r['name']}\n")
        return 0
    scalar = g.kind(compiled(a.xpath)) != g.NODESET
    found = results(spark, a)
    if not (a.count or a.files_with_matches or a.raw or a.json or a.keep_whitespace):
        found = found.where(F.col("value").rlike(r"\S"))
    if a.files_with_matches:
        rows = [r["uri"] for r in found.select("uri").distinct().orderBy("uri").toLocalIterator()]
        out.writelines(u + end for u in rows)
        return 0 if rows else 1
    if a.count and not scalar:
        counts = documents(spark, a).select("uri").join(found.groupBy("uri").count(), "uri", "left").select("uri", F.coalesce("count", F.lit(0)).alias("n")).orderBy("uri")
        total = 0
        for r in counts.toLocalIterator():
            total += r["n"]
            out.write((f"{r['uri']}:" if many else "") + f"{r['n']}{end}")
        return 0 if total else 1
    n, rows = 0, found.orderBy("uri", "pre", "aord").toLocalIterator()
    if a.json:
        out.write("[")
    for r in rows:  # one partition at a time, so any number of results can be printed
        if a.json:
            out.write((", " if n else "") + json.dumps({"file": r["uri"], "value": r["value"]} if many else r["value"], ensure_ascii=False))
        else:
            out.write((f"{r['uri']}:" if many else "") + r["value"] + end)
        n += 1
    if a.json:
        out.write("]" + end)
    return 0 if n else 1


def main(argv: list[str], out=sys.stdout, spark: SparkSession | None = None) -> int:
    try:
        a = _arguments(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.xpath != "info":
            compiled(a.xpath)
        spark = spark or SparkSession.builder.master(f"local[{a.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").getOrCreate()
        return run(spark, a, out)
    except Exception as e:
        print(f"xylem: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
