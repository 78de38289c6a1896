import pytest

from lodeseek.functions import answers
from lodeseek.sources import records


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n{"ranking": [{"dataset_id": " a ", "score": "0.5", "reason": "r"}, {"score": 1}, "b", {"dataset_id": "c", "score": "x"}]}\n```', [("a", 0.5, "r"), ("b", None, ""), ("c", None, "")]),
        ('["a", 3]', [("a", None, "")]),
        ("1. 0123abcd-ef | 0.75\n2) deadbeef\nnonsense\n3: short", [("0123abcd-ef", 0.75, ""), ("deadbeef", None, "")]),
        ('{"ranking": []}', []),
        ('{"other": 1}', []),
        ("5", []),
        (None, []),
    ],
)
def test_ranking_answers(text, want):
    assert answers.parse_ranking(text) == want


def test_rankings(spark):
    df = spark.createDataFrame([("q", '["a", "b"]'), ("z", None)], "query_id string, answer string")
    assert [(r.query_id, r.pos, r.dataset_id) for r in answers.rankings(df).orderBy("pos").collect()] == [("q", 0, "a"), ("q", 1, "b")]


def test_headers(spark):
    rows = spark.createDataFrame([(0, ["It's A", "x"]), (1, ["b", None]), (2, ["1", "2"])], "seq long, cells array<string>")
    assert answers.with_header(rows).columns == ["seq", "It's A", "x"] and answers.with_header(rows).count() == 2
    merged = answers.with_header(rows, merge=True)
    assert merged.columns == ["seq", "its_a_b", "x"] and merged.collect()[0][1:] == ("1", "2")


def test_baselines():
    assert answers.parse_baselines(" Dense,sparse,dense ") == ["dense", "sparse"]
    for bad in ("", "dense,odd"):
        with pytest.raises(ValueError):
            answers.parse_baselines(bad)


def test_checkpoints_and_caches(spark, tmp_path):
    schema = "dataset_id string, file_path string, dataset_name string"
    path = str(tmp_path / "r")
    assert records.load_records(spark, path, schema).count() == 0
    with pytest.raises(FileNotFoundError):
        records.load_records(spark, path, schema, required=True)
    records.save_records(spark.createDataFrame([("a", "/x/1", "n1"), ("b", "/gone", "n2"), ("c", None, "n3")], schema), path)
    files = spark.createDataFrame([("/x/1",), ("/root/n2",)], "path string")
    got = {r.dataset_id: r.resolved for r in records.resolve_file(records.load_records(spark, path, schema), files, "/root/").collect()}
    assert got == {"a": "/x/1", "b": "/root/n2", "c": None}
    keys = spark.createDataFrame([("1",), ("2",)], "query_id string")
    cache = spark.createDataFrame([("1", "one"), ("9", "nine")], "query_id string, text string")
    with pytest.raises(ValueError, match="for 1: 2"):
        records.require_complete(keys, cache)
    both = records.read_through(keys, cache, "query_id", lambda k: k.selectExpr("query_id", "'new' AS text"))
    assert {(r.query_id, r.text) for r in both.collect()} == {("1", "one"), ("2", "new")}


def test_collections(spark, tmp_path):
    spark.createDataFrame([("a", "with")], "doc_id string, variant string").write.parquet(str(tmp_path / "i"))
    assert records.open_collection(spark, str(tmp_path / "i"), "with").count() == 1
    with pytest.raises(ValueError, match="there are: with"):
        records.open_collection(spark, str(tmp_path / "i"), "without")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.12345678), ("a", 1.0), ("a", 2.0)], "id string, v double")
    records.write_lines(df, "id", str(tmp_path / "ids"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b"]
    assert records.load_ids(spark, str(tmp_path / "ids")).count() == 2
    records.write_metrics(df, str(tmp_path / "m"))
    assert ("b", "0.123457") in {tuple(r) for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()}
    assert records.markdown(spark.createDataFrame([("x|y\nz",)], "c string")) == "| c |\n|---|\n| x\\|y<br>z |"
