import pytest
from pyspark.sql import functions as F

from simgrove.errors import ProblemError
from simgrove.functions import text as T
from simgrove.functions.porter import stem
from simgrove.operators import corpus as Q


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert one(spark, T.tokens, "AI, ML. co-operative 3D-model!") == "ai ml co operative 3d model".split()
    assert one(spark, T.tokens, "The cat sat on the mat") == ["cat", "sat", "mat"]
    assert one(spark, T.tokens, None) == [] and one(spark, T.tokens, "Café") == ["café"]


def test_stems(spark):
    pairs = "caresses:caress running:run conflated:conflat agreed:agre relational:relat horses:hors ponies:poni hopping:hop falling:fall filing:file happy:happi sky:sky vietnamization:vietnam adoption:adopt controll:control rate:rate probate:probat feed:feed plastered:plaster"
    assert {x.split(":")[0]: stem(x.split(":")[0]) for x in pairs.split()} == dict(x.split(":") for x in pairs.split())
    df = spark.createDataFrame([(1, ["running", "horses", "running"]), (2, [])], "id int, tokens array<string>")
    assert {r.id: r.tokens for r in T.stemmed(df).collect()} == {1: ["run", "hors", "run"], 2: []}


def test_clean(spark):
    assert one(spark, T.clean, "  A study of infor-\nmation reﬁnement\n\nacross   multiple\nlines.  ") == "A study of information refinement across multiple lines."


def test_quality(spark):
    assert one(spark, T.quality_reasons, "x" * 600 + " end.") == []
    assert one(spark, T.quality_reasons, "cut off with the") == ["too-short", "no-terminal-punctuation", "dangling-connector"]
    assert one(spark, T.quality_reasons, "x" * 600 + ' said it."') == []


def test_hashes(spark):
    df = spark.createDataFrame([("d02", "Another abstract."), ("d01", "Test abstract one.")], "id string, t string").withColumn("abstract_sha256", Q.text_sha256(F.col("t")))
    assert Q.corpus_sha256(df).first()[0] == "1311812eb3bdb0901129894bee5bd0b70383c317f600e890bbb1aa5be05b00a0"


def test_verify_and_validate(spark):
    schema = "id string, title string, authors array<string>, abstract string, manually_validated boolean, abstract_sha256 string"
    df = spark.createDataFrame([("a", "t", ["x"], "cats sat", True, None), ("a", " ", [], "the", False, "?"), ("b", "t", ["x"], " ", True, "?")], schema)
    rules = {(r.rule, r.document_id) for r in Q.verify(df, 2, 3, "no").collect()}
    assert rules >= {("UNIQUE_DOCUMENT_ID", "a"), ("NON_BLANK_TITLE", "a"), ("NON_EMPTY_AUTHORS", "a"), ("NON_BLANK_ABSTRACT", "b"), ("MANUALLY_VALIDATED", "a"), ("NON_EMPTY_PREPROCESSED_TOKENS", "a"), ("ABSTRACT_SHA256_MATCHES_RECOMPUTED", "a"), ("NO_DUPLICATE_ABSTRACT_SHA256", "b"), ("DOCUMENT_COUNT_MATCHES_SOURCE_COUNT", None), ("CORPUS_SHA256_MATCHES_RECOMPUTED", None)}
    assert ("DOCUMENT_COUNT_MATCHES_EXPECTED", None) not in rules and ("MINIMUM_DOCUMENT_COUNT", None) not in rules
    assert Q.validate(df, ["b"]).where("id = 'b'").first().abstract_sha256 != "?"
    with pytest.raises(ProblemError):
        Q.validate(df, ["zz"])


def test_sources(spark, tmp_path):
    from simgrove.sources import files

    (tmp_path / "c.json").write_text('{"version": "1",\n "documents": [{"id": "d01", "title": "t", "authors": ["x"], "abstract": "a"}, {"id": "d02"}]}')
    head, docs = files.read_corpus(spark, str(tmp_path / "c.json"))
    assert [r.id for r in docs.orderBy("corpus_order").collect()] == ["d01", "d02"] and head.first().version == "1"
    (tmp_path / "e.json").write_text('{"dimension": 2, "corpusSha256": "s", "vectors": [{"id": "d01", "preNormL2": 1.0, "values": [3, 4]}]}')
    assert files.read_embeddings(spark, str(tmp_path / "e.json"), "s").first().vec == [0.6, 0.8]
    with pytest.raises(ProblemError):
        files.read_embeddings(spark, str(tmp_path / "e.json"), "other")
    (tmp_path / "b.csv").write_text("# harness.jdk=25\nbenchmark,family,parameter,size,score,error,unit\nx,f,n,5.0,1.0,0.1,us/op\nx,f,n,10.0,2.0,0.1,us/op\n")
    harness, rows = files.read_benchmark_csv(spark, str(tmp_path / "b.csv"))
    assert harness == {"jdk": "25"} and rows.count() == 2
    (tmp_path / "j.json").write_text('[{"benchmark": "b", "params": {"n": "5"}, "primaryMetric": {"score": 1.5, "scoreError": NaN, "scoreUnit": "us/op"}}]')
    assert files.read_jmh(spark, str(tmp_path / "j.json")).first().score == 1.5
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt><sourceDesc><author><persName><forename>A</forename><surname>B</surname></persName></author></sourceDesc></fileDesc><profileDesc><abstract><p>one</p><p>two</p></abstract></profileDesc></teiHeader></TEI>'
    got = spark.createDataFrame([(xml,)], "x string").select(*[v.alias(k) for k, v in files.tei_header(F.col("x")).items()]).first()
    assert (got.title, got.authors, got.abstract) == ("T", ["A", "B"], "one two")
