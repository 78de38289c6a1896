import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import catalog, profile, search
from lodeseek.sources import tables, trec


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("path", "kind"), [("x/a.text.csv", "csv"), ("a.csv.bak", "csv"), ("B.XLSX", "excel"), ("noext", None), ("a.pdf", None), ("h.h5", "hdf"), ("csv", None)])
def test_format_of_path(spark, path, kind):
    assert one(spark, T.format_of_path(F.col("p")), p=path) == kind


def test_format_of_url(spark):
    assert one(spark, T.format_of_url(F.col("u")), u="https://a.b/c%2Ecsv?x=y.json#z") == "csv"
    assert one(spark, T.format_of_url(F.col("u")), u="https://data.json/plain") is None


@pytest.mark.parametrize(("name", "kind"), [("CSV (Comma-Separated  Values)", "csv"), (" x l s ", "excel"), ("pdf", None), ("ndjson", "json")])
def test_canonical_format(spark, name, kind):
    assert one(spark, T.canonical_format(F.col("n")), n=name) == kind


def test_include_formats():
    assert T.include_formats("CSV, .xlsx,xls, odd,,") == ["csv", "excel", "odd"]


@pytest.mark.parametrize(("text", "value"), [("1", 1), ("1e3", 1000), (" 12 ", 12), (".5", 0.5), ("5.", 5), ("1_000", None), ("1,000", None), ("0x10", None), ("True", None), ("", None), ("1d", None), ("1f", None), ("nan", None), ("inf", float("inf"))])
def test_number(spark, text, value):
    assert one(spark, T.number(F.col("x")), x=text) == value


def test_lists(spark):
    assert one(spark, T.numbered_list(F.col("x")), x='1) "a"\n2. b\n- a\n* c\n5: d\nplain\n\n') == ["a", "b", "c", "d", "plain"]
    assert one(spark, T.split_numbered(F.col("x")), x="a 3.5 b 1. c") == ["a ", "5 b ", "c"]


def test_table_text_round_trip(spark):
    names, rows = T.parse_table_text(F.col("x"))
    r = spark.createDataFrame([("Columns: a | b\n1 | 2\n3\n4 | 5 | 6",)], "x string").select(names.alias("n"), rows.alias("r")).first()
    assert r.n == ["a", "b"] and r.r == [["1", "2"], ["3", ""], ["4", "5"]]


def test_document_text_keeps_the_word_none(spark):
    assert one(spark, T.document_text(F.col("a"), F.col("b"), F.col("c")), a=" x ", b=None, c="") == "x\nNone"


def test_make_unique():
    assert T.make_unique(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]


def seq(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "seq long, line string")


def test_qrels(spark):
    got = {(r.query_id, r.dataset_id): r.rel for r in trec.parse_qrels(seq(spark, "q1 0 d1 2", "q1 d2 L1", "q1 d3 L2 extra", "q1 d4 L1 5", "q3 d6 -1", "q3 d6 1", "", "q x")).collect()}
    assert got == {("q1", "d1"): 2, ("q1", "d2"): 1, ("q1", "L2"): 0, ("q1", "L1"): 5, ("q3", "d6"): 1}


def test_topics(spark):
    rows = seq(spark, "1\ta\tb", "2\t ", "x", "1\tlast")
    assert [(r.query_id, r.text) for r in trec.parse_topics(rows).collect()] == [("1", "last")]
    assert trec.parse_topics(rows, keep_all=True).count() == 3


def test_run_round_trip(spark, tmp_path):
    run = trec.parse_run(seq(spark, "q Q0 d1 2 0.5 r", "q Q0 d2 x nan r", "q Q0  d3 1 1 r more", "short"))
    assert {(r.dataset_id, r.rank, r.score) for r in run.collect()} == {("d1", 2, 0.5), ("d2", 999999, 0.0), ("d3", 1, 1.0)}
    lines = trec.run_lines(run, "me", k=2)
    trec.write_run(lines, str(tmp_path / "run"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "run")).collect()] == ["q Q0 d3 1 1.000000 me", "q Q0 d1 2 0.500000 me"]


def test_scores_of_lines_are_written_as_c_does(spark):
    """Exact binary values, ties to even; Java's formatter gives 24418.000008 and 0.007813."""
    numbers = [24418.0000075, 6627.0000285, 0.0078125, 0.0234375, -0.0078125, 2.5e-7, -0.0, 12345678901.1234567, 2.0**33 - 2**-20, 1e15 + 0.25, -1e12 - 0.9999, 1e17, float("nan"), float("inf"), float("-inf")]
    run = spark.createDataFrame([("q", "d", i + 1, x) for i, x in enumerate(numbers)], "query_id string, dataset_id string, rank int, score double")
    got = [r.line.split(" ")[4] for r in trec.run_lines(run, "me").orderBy("rank").collect()]
    assert got == ["%.6f" % x for x in numbers]


def test_files(spark, tmp_path):
    (tmp_path / "dom" / "id1").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "dom" / "id1" / name).write_bytes(data)
    put("a.csv", b"x;y\n1;2\n3\n4;5;6\n")
    put("b.json", json.dumps([{"x": 1, "n": {"k": [1]}}]).encode())
    put("c.jsonl", b'{"x": 1}\n{"x": 2}\n')
    put("d.html", b"<html><table><tr><th>h</th></tr><tr><td>v &amp; w</td></tr></table><table><tr><td>no</td></tr></table></html>")
    put("e.html", b"<html><p>none</p></html>")
    put("f.csv.gz", gzip.compress(b"a,b\n1,2\n"))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("m.json", '[{"q": 1}]')
        z.writestr("empty.csv", "")
    put("g.zip", buf.getvalue())
    put("h.txt", b"just words here\nand more words, too\n")
    put("i.csv", b"  \n ")
    put("j.latin.csv", "naïve,b\né,2\n".encode("latin-1"))
    rows = tables.read_files(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.cells or r.reason)
    assert by["a.csv"] == [{"x": "1", "y": "2"}, {"x": "3", "y": ""}]
    assert by["b.json"] == [{"x": "1", "n": '{"k": [1]}'}] and by["c.jsonl"] == [{"x": "1"}, {"x": "2"}]
    assert by["d.html"] == [{"h": "v & w"}] and by["e.html"] == ["html_non_tabular"] and by["f.csv.gz"] == [{"a": "1", "b": "2"}]
    assert by["g.zip"] == [{"q": "1"}] and by["i.csv"] == ["empty_file"] and by["j.latin.csv"] == [{"naïve": "é", "b": "2"}] and len(by["h.txt"]) >= 1
    found = tables.discover(spark, str(tmp_path), limit=0).collect()
    assert [r.relative_path for r in found] == ["dom/id1/a.csv"]
    ids = catalog.infer_ids(tables.discover(spark, str(tmp_path))).first()
    assert (ids.domain, ids.dataset_id, ids.dataset_name) == ("dom", "id1", "dom/id1/a.csv")


def test_signature(spark):
    df = spark.createDataFrame([(bytearray(b"PK\x03\x04x"),), (bytearray(b" <!DOCTYPE html><p>"),), (bytearray(b" \n\t"),), (bytearray(b"a,b"),)], "c binary")
    assert [r[0] for r in df.select(tables.signature(F.col("c"))).collect()] == ["zip", "html", "blank", "other"]


def test_states(spark):
    schema = "dataset_id string, processable boolean, status string, data_profile string, exclusion_reason string, error_message string"
    r = spark.createDataFrame([("a", None, "ok", "p", None, None), ("b", True, "excluded", None, None, "bad"), ("c", False, "x", None, None, None), ("d", None, "ok", None, None, None)], schema)
    got = {x.dataset_id: (x.processable, x.exclusion_reason) for x in catalog.normalise_states(r).collect()}
    assert got == {"a": (True, None), "b": (False, "bad"), "c": (False, "unprocessable"), "d": (None, None)}


def test_profile_of_coerced_numbers(spark):
    df = spark.createDataFrame([("1", True), ("2.5", False), ("1d", None), (None, True)], "s string, b boolean")
    got = {r.column: r for r in profile.global_stats(df).collect()}
    assert (got["s"].numeric_count, got["s"].sum, got["s"].nulls, got["s"].missing_pct) == (2, 3.5, 1, 25.0)
    assert (got["b"].numeric_count, got["b"].sum) == (3, 2.0) and got["b"].std == pytest.approx((2 / 3 - 4 / 9) ** 0.5)


def test_bm25_ties_by_id_as_text(spark):
    docs = spark.createDataFrame([("9", "same words"), ("10", "same words"), ("11", "other")], "dataset_id string, text string")
    q = spark.createDataFrame([("q", "words")], "query_id string, text string")
    assert [r.dataset_id for r in search.bm25(docs, q).orderBy("rank").collect()] == ["10", "9"]


def test_first_documents(spark):
    rows = spark.createDataFrame([(0, "a", " "), (1, " a ", "x"), (2, "a", "y"), (3, "", "z")], "seq long, dataset_id string, text string")
    assert [(r.dataset_id, r.text) for r in search.first_documents(rows).collect()] == [("a", "x")]
