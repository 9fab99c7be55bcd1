"""Conversion, folds and queries end to end."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.operators import convert, fold
from docloom.sources import scans, sinks
from docloom.sources.pdf import simple_pdf
from docloom.sources.registry import function_parser

SF = "/root/testdata/sf0.001"


def test_fold(spark):
    rows = [("d", 1, "progress", None, None, "Reading", None), ("d", 2, "append", "a", '<p id="a">1</p>', None, None), ("d", 3, "replace", "a", '<p id="a">2</p>', None, None), ("d", 4, "done", None, None, None, None), ("d", 5, "append", "b", '<p id="b">late</p>', None, None), ("e", 1, "error", None, None, None, "x<y")]
    got = {r.doc_id: r for r in fold.fold(spark.createDataFrame(rows, "doc_id string, pos long, type string, id string, html string, phase string, message string")).collect()}
    assert (got["d"].seq, got["d"].status, [b.html for b in got["d"].blocks]) == (4, "done", ['<p id="a">2</p>'])
    assert got["e"].status == "error" and "x&lt;y" in got["e"].blocks[0].html


def test_convert_modes(spark):
    calls = spark.sparkContext.accumulator(0)

    def parse(content, media_type, part):
        calls.add(1)
        if part == 2:
            raise RuntimeError("model is down")
        yield "<h1>Ti"
        yield f"tle {part}</h1><script>x</script><p>text"

    sources = spark.createDataFrame([("pdf", bytearray(simple_pdf([(1, 1), (2, 2), (3, 3)])), "application/pdf", "a.pdf"), ("png", bytearray(b"\x89PNG"), "image/png", "b.png")], "doc_id string, content binary, media_type string, name string")
    parser = function_parser(parse, wait=lambda n: 0)
    got = {r.doc_id: r for r in convert.render(sources, parser).collect()}
    assert [b.id for b in got["pdf"].blocks] == ["page-1", "page-2", "page-3"]
    assert "Title 1" in got["pdf"].blocks[0].html and "Page 2 could not be converted. model is down" in got["pdf"].blocks[1].html
    assert "script" not in got["pdf"].blocks[2].html and got["pdf"].status == "done"
    assert [b.html for b in got["png"].blocks] == ['<h1 id="block-1">Title None</h1>', '<p id="block-2">text</p>']
    assert calls.value == 6  # two parts and the whole source once, the failing part once and twice anew
    limited = {r.doc_id: r for r in convert.render(sources, parser, convert.Options(max_parts=2)).collect()}
    assert limited["pdf"].status == "error" and "the limit is 2" in limited["pdf"].blocks[0].html


def test_harmless_sources(spark):
    sources = spark.createDataFrame([("a\x00b", bytearray(b"caf\xff\n\n# ok"), "text/plain", "a"), ("c", bytearray(b""), "text/plain", "c")], "doc_id string, content binary, media_type string, name string")
    got = {r.doc_id: r for r in convert.render(sources, "plain_text").collect()}
    assert [b.html for b in got["a\x00b"].blocks] == ['<p id="block-1">caf\ufffd</p>', '<h1 id="block-2">ok</h1>']
    assert (got["c"].status, got["c"].blocks) == ("done", [])
    rows = function_parser(lambda c, m, p: iter(["x", "", "y"]))(sources.limit(1)).collect()
    assert [(r.chunk_seq, r.delta, r.is_last) for r in rows] == [(0, "x", False), (1, "y", False), (2, "", True)]


def test_failed_sessions(spark, tmp_path):
    sources = spark.createDataFrame([("s", bytearray(b"x"), "image/png", "a")], "doc_id string, content binary, media_type string, name string")

    def broken(rows):
        raise RuntimeError("no parser today")

    got = convert.run_sessions(sources, str(tmp_path / "store"), broken).collect()
    assert [(r.doc_id, r.status, r.blocks[0].html) for r in got] == [("s", "error", '<p id="error" class="error" role="alert">no parser today</p>')]
    assert sinks.load(spark, str(tmp_path / "store")).count() == 1


def test_step_ends_documents(spark):
    p = lambda i: f'<p id="{i}">x</p>'
    rows = [("d", 1, "replace", "loading", p("loading"), None, None), ("d", 2, "append", "a", p("a"), None, None), ("d", 3, "replace", "loading", p("loading"), None, None), ("d", 4, "append", "b", p("b"), None, None)]
    rows += [("e", 1, "append", "loading", p("loading"), None, None), ("f", 1, "replace", "loading", p("loading"), None, None)]
    got = {r.doc_id: r for r in fold.fold(fold.step(spark.createDataFrame(rows, "doc_id string, pos long, type string, id string, html string, phase string, message string"))).collect()}
    assert got["d"].status == "error" and [b.id for b in got["d"].blocks] == ["a", "error"] and "replace target #loading does not exist" in got["d"].blocks[1].html
    assert "duplicate block id #loading" in got["e"].blocks[0].html
    assert (got["f"].status, got["f"].blocks[0].html) == ("running", p("loading"))


def load_queries():
    import __spark_entry__ as entry
    from docloom.plans.queries import QUERIES

    return entry, QUERIES


@pytest.mark.parametrize("name", ["text_documents", "layout_html", "markdown_blocks", "event_snapshots", "event_frames", "event_steps", "event_gaps", "part_sections", "candidate_streams", "upload_checks", "conversation_documents", "convert_documents", "split_limits", "live_parts", "model_layout", "model_markdown", "http_requests", "markdown_cuts", "snapshot_bodies", "stored_sessions", "upload_bodies"])
def test_query_equals_sql(spark, name):
    entry, queries = load_queries()
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert ours == sorted(map(repr, con.sql(entry.oracle_sql()[name]).project(", ".join(cols)).fetchall()))


def test_file_sources_of_folders(spark, tmp_path):
    """A table of part files, even in folders of values, is one source; other files of the folder are none."""
    entry, queries = load_queries()
    for name in sorted(os.listdir(SF)):
        if name == "documents.parquet":
            spark.read.parquet(f"{SF}/{name}").repartition(3).write.parquet(str(tmp_path / name))
        elif name == "pages.parquet":
            spark.read.parquet(f"{SF}/{name}").withColumn("half", F.col("page_id") % 2).write.parquet(str(tmp_path / name), partitionBy=["half"])
        else:
            os.symlink(f"{SF}/{name}", tmp_path / name)
    (tmp_path / "notes.txt").write_text("x")
    df = queries["file_sources"](spark, str(tmp_path) + "/")
    ours = sorted(map(tuple, df.collect()))
    assert ours == sorted(duckdb.connect().sql(entry.oracle_sql()["file_sources"]).project(", ".join(df.columns)).fetchall())
    read = {r.name: r for r in scans.read_files(spark, str(tmp_path), "*[ts].*", folders=True).collect()}
    assert {n for n in os.listdir(tmp_path) if n.partition(".")[0][-1] in "ts"} == set(read)
    assert bytes(read["notes.txt"].content) == b"x" and read["documents.parquet"].content is None


def test_pages_are_safe(spark):
    _, queries = load_queries()
    rows = queries["page_sanitized"](spark, SF)
    assert rows.filter(F.col("html").rlike(r"(?i)<script|<style|\son[a-z]+=|<meta|href=\"/")).count() == 0
    assert queries["page_blocks"](spark, SF).filter("id is null or html = ''").count() == 0


def test_entry(spark):
    entry, _ = load_queries()
    assert entry.entry(spark).count() == 200
