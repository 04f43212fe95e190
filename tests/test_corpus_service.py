"""Ingestion, benchmark files, caches and the facade's errors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from simgrove.engine import Engine, json_body
from simgrove.errors import ProblemError
from simgrove.functions import vectors as V
from simgrove.operators import benchmarks as B
from simgrove.operators import ingest as I
from simgrove.operators import synthetic as G
from simgrove.operators import traces as X
from simgrove.sources import files

PAPER = "On  Token Align-\nment\r\nIgnored\n"
TEXT = "  A Study of Things \n\nAda Lovelace, Bob and Carol & D\nAffiliation\nAbstract: First line\nsecond hyphen-\nated line.\n\nI N T R O D U C T I O N\nBody"


def one(spark, df_column):
    return spark.range(1).select(df_column.alias("x")).first().x


def test_metadata_of_a_text(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, "Only title"), (4, "T\nA\nABSTRACT\n" + "word " * 900 + "\n" + "more\n" * 3 + "Keywords x")], "id int, text string")
    got = {r.id: r for r in rows.select("id", *[c.alias(k) for k, c in I.text_metadata(F.col("text")).items()]).collect()}
    assert tuple(got[1])[1:] == ("A Study of Things", ["Ada Lovelace", "Bob", "Carol", "D"], "First line second hyphenated line.")
    assert tuple(got[2])[1:] == ("", [], "") and tuple(got[3])[1:] == ("Only title", [], "")
    assert got[4].abstract == ("word " * 900).strip()  # lines stop beyond the limit


def test_choice_between_attempts(spark):
    good, short = "Long enough. " * 60, "too short"
    cases = [(good, short, "primary"), (short, good, "fallback"), (short, "a bit longer text", "fallback"), (short, short, "primary"), (None, short, "fallback"), (short, " ", "primary"), ("", None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.w for r in df.select("i", I.chosen_attempt(F.col("a"), F.col("b")).alias("w")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


def test_ingest(spark, tmp_path):
    for name, text in (("b.PDF", TEXT), ("a.pdf", "T\nX and Y\nAbstract\n" + "Fine words here. " * 40), ("c.Pdf", "broken"), ("n.txt", "no")):
        (tmp_path / name).write_text(text)

    def read(content):
        if content == b"broken":
            raise ValueError("broken")
        return content.decode()

    got = I.ingest(spark, str(tmp_path), read, lambda content: "F\nZ\nAbstract. fallback text", ("one", "two")).orderBy("id").collect()
    assert [(r.id, r.title, r.authors, r.extracted_by, r.source.rsplit("/", 1)[1]) for r in got] == [("d01", "T", ["X", "Y"], "one", "a.pdf"), ("d02", "A Study of Things", ["Ada Lovelace", "Bob", "Carol", "D"], "one", "b.PDF"), ("d03", "F", ["Z"], "two", "c.Pdf")]
    assert not any(r.manually_validated for r in got) and all(len(r.abstract_sha256) == 64 for r in got)
    line = spark.range(1).select(I.quality_line(F.lit("d1"), F.lit("x"), F.lit("short")).alias("s")).first().s
    assert line == "  d1 [x] 5 chars - suspicious: too-short; no-terminal-punctuation"
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ProblemError):
        I.ingest(spark, str(empty), read)


def test_corpus_and_cache_read_back(spark, tmp_path):
    docs = spark.createDataFrame([("d02", "T2", ["a"], "x\ny", "s", "e", True, "h2"), ("d01", "T1", [], "é", "s", None, False, "h1")], "id string, title string, authors array<string>, abstract string, source string, extracted_by string, manually_validated boolean, abstract_sha256 string")
    files.write_corpus(docs, str(tmp_path / "c"))
    head, back = files.read_corpus(spark, str(tmp_path / "c"))
    assert head.first().sourceCount == 2 and len(head.first().corpusSha256) == 64
    assert sorted(map(tuple, back.drop("corpus_order").select(*docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    vectors = I.embedded(docs, lambda texts: [[len(t), 1.0] for t in texts], 2)
    files.write_embeddings(vectors.withColumnRenamed("values", "vec"), str(tmp_path / "v"), "1", "sha", "m")
    got = files.read_embeddings(spark, str(tmp_path / "v"), "sha").collect()
    assert sorted(r.id for r in got) == ["d01", "d02"] and all(np.isclose(np.linalg.norm(r.vec), 1) for r in got)
    with pytest.raises(ProblemError):
        files.read_embeddings(spark, str(tmp_path / "v"), "another")
    with pytest.raises(Exception, match="dimension 3"):
        I.embedded(docs, lambda texts: [[1.0, 2.0] for _ in texts], 3).count()
    assert files.norm_warnings(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "id string, values array<double>")).first().id == "b"


def test_benchmark_families_and_files(spark, tmp_path):
    raw = [("x.LevenshteinBenchmark.pairwiseCompute", {"length": str(n)}, n * n * 2.0) for n in (50, 100, 200)] + [("x.LanceWilliamsBenchmark.agglomerate", {"n": "5", "linkage": "ward"}, 1.0), ("x.Other.run", {"n": "1", "b": "2", "a": "1"}, 3.0)]
    df = spark.createDataFrame([(b, p, s, 0.5, "us/op") for b, p, s in raw], "benchmark string, params map<string,string>, score double, error double, unit string")
    rows = B.export_ready(df)
    assert [r.family for r in rows.collect()] == ["levenshtein"] * 3 + ["hac-ward", "Other.run-1-2"]
    bad = spark.createDataFrame([("plain", {"n": "1"}), ("a.B", {}), ("a.B", {"n": "1", "length": "2"}), ("a.B", {"n": "x"})], "benchmark string, params map<string,string>")
    assert [r.problem for r in B.classified(bad).collect()] == ["not a qualified name", "no size", "several sizes", "a size that is no number"]
    with pytest.raises(ProblemError, match="several sizes"):
        B.export_ready(bad)
    harness = {k: "1" for k in B.HARNESS}
    results, slopes, side = (str(tmp_path / x) for x in ("out/results.csv", "slopes.csv", "harness.txt"))
    B.write_results(rows, harness, results)
    B.write_slopes(rows, slopes)
    head, table, found = B.read_report(spark, results, slopes)
    assert head == harness and table.count() == 5 and [tuple(r) for r in found.collect()] == [("levenshtein", 3, 2.0, 2.0)]
    B.write_sidecar(harness, side, results)
    assert B.read_sidecar(side, results)["jdk"] == "1"
    with pytest.raises(ProblemError):
        B.read_sidecar(side, slopes)
    assert one(spark, B.jdk_of(F.lit("OpenJDK Runtime 25.0.4"))) == "25.0.4"
    good = open(results).read()
    for broken in (good.replace(",0.5,", ",NaN,"), good.replace("benchmark,family", "foo,bar"), good.replace("# harness.os = 1\n", ""), good.replace("us/op", ""), good.split("x.Lev")[0], good.replace(",0.5,", ",1e999,")):
        (tmp_path / "broken.csv").write_text(broken)
        with pytest.raises(ProblemError):
            B.read_report(spark, str(tmp_path / "broken.csv"), slopes)
    for broken in ("foo,bar,baz,d,e,f,g\nx,y,n,1,2,3,u\n", f"{B.RESULTS}\nx,y,n,1,NaN,3,u\n"):
        (tmp_path / "lax.csv").write_text(broken)
        with pytest.raises(Exception):  # noqa: B017
            files.read_benchmark_csv(spark, str(tmp_path / "lax.csv"))[1].collect()


def test_pooling(spark):
    v = F.array(*[F.array(*map(F.lit, x)) for x in ([1.0, 2.0], [3.0, 4.0], [9.0, 9.0])])
    assert one(spark, V.pool_tokens(v, F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 3.0] and one(spark, V.pool_windows(v)) == [13 / 3, 5.0]
    for bad in (V.pool_tokens(v, F.array(F.lit(0), F.lit(0), F.lit(0))), V.pool_tokens(v, F.array(F.lit(1))), V.pool_windows(F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))):
        with pytest.raises(Exception, match="length"):
            one(spark, bad)


def test_synthetic(spark):
    rows = G.unit_vectors(spark, 20, 8, 3).collect()
    assert all(np.isclose(np.linalg.norm(r.vec), 1) for r in rows) and len({tuple(r.vec) for r in rows}) == 20
    assert [r.vec for r in G.unit_vectors(spark, 20, 8, 3).collect()] == [r.vec for r in rows] and G.cosine_distances(spark, 5, 4).count() == 10
    assert G.token_sequences(list("abcde"), 7, 6) == (list("bcdeabc"), list("deabcde"))


@pytest.fixture
def engine(spark):
    docs = spark.createDataFrame([(f"d{i}", f"T{i}", ["x"], t, "secret", "e", True, "h") for i, t in enumerate(["alpha beta gamma", "alpha beta delta", "omega psi alpha", "beta gamma delta"])], "id string, title string, authors array<string>, abstract string, source string, extracted_by string, manually_validated boolean, abstract_sha256 string")
    vectors = spark.createDataFrame([("d0", [1.0, 0.0]), ("d1", [0.6, 0.8]), ("d2", [0.0, 1.0])], "id string, values array<double>")
    with Engine(docs, vectors, provider="p", model="m") as e:
        yield e


def test_facade(spark, engine, tmp_path):
    assert engine.get_document("d1").columns == ["id", "title", "authors", "abstract"]
    assert engine.compare("d0", "d1").count() == 6 and engine.compare("d0", "d1") and len(engine._results) == 6
    for call in (lambda: engine.compare("d0", "d3"), lambda: engine.matrix(["d0", "d1", "d3"], "embedding-api"), engine.require_coverage):
        with pytest.raises(ProblemError, match="d3"):
            call()
    steps = engine.cluster(None, ["average"])
    assert steps.count() == 3 and engine.cut(None, "average", 2).count() == 4
    assert {r.id for r in engine.cut(None, "average", 3).collect()} == {"d0", "d1", "d2", "d3"} and sum(k[0] == "cluster" for k in engine._results) == 1
    status = engine.embeddings_status().first()
    assert (status.provider, status.model, status.dimension, status.vectors, status.matches_corpus) == ("p", "m", 2, 3, None) or status.matches_corpus is False
    assert json.loads(json_body(engine.list_documents()).first().body)["id"] == "d0"
    blank = Engine(engine.docs.withColumn("abstract", F.when(F.col("id") == "d2", "the of").otherwise(F.col("abstract"))))
    with pytest.raises(ProblemError, match="d2"):
        blank.cluster()


def test_traces_agree_with_scores(spark, engine):
    score = {r.algorithm: r for r in engine.compare("d0", "d1").collect()}
    totals = X.tfidf_totals(engine.prepared, engine.prepared.where("id = 'd0'")).where("b = 'd1'").first()
    assert np.isclose(totals.cosine, score["tfidf-cosine"].raw_value) and totals.corpus_size == 4
    terms = engine.trace("tfidf-cosine", "d0", "d1").collect()
    assert np.isclose(sum(r.unit_a * r.unit_b for r in terms), totals.cosine) and np.isclose(sum(r.w_a * r.w_b for r in terms), totals.dot) and all(np.isclose(r.tf_a * r.idf, r.w_a) for r in terms)
    e = engine.trace("embedding-local", "d0", "d1").first()
    assert np.isclose(e.local_score, score["embedding-local"].normalized_score) and np.isclose(e.api_score, score["embedding-api"].normalized_score) and (e.dimension, e.provider_status) == (2, "cached")
    assert np.isclose(engine.trace("jaccard", "d0", "d1").first().coefficient, score["jaccard"].raw_value)
    for kind in ("levenshtein", "needleman-wunsch"):
        assert engine.trace(kind, "d0", "d1").first().matrix[-1][-1] == score[kind].raw_value
    empty = spark.createDataFrame([(1, []), (2, []), (3, ["a"])], "id int, tokens array<string>")
    got = {r.b: (r.cosine, r.angle, r.norm_a) for r in X.tfidf_totals(empty, empty.where("id = 1")).collect()}
    assert got == {1: (1.0, 0.0, 0.0), 2: (1.0, 0.0, 0.0), 3: (0.0, 90.0, 0.0)}
