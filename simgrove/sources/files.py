"""Readers and writers of the corpus's own file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.errors import ProblemError
from simgrove.functions import vectors as V

DOCUMENT = "id string, title string, authors array<string>, abstract string, source string, extractedBy string, manuallyValidated boolean, abstractSha256 string"
CORPUS = f"version string, sourceCount int, corpusSha256 string, documents array<struct<{', '.join(x.replace(' ', ':', 1) for x in DOCUMENT.split(', '))}>>"
CACHE = "version string, corpusVersion string, corpusSha256 string, model string, dimension int, vectors array<struct<id:string,preNormL2:double,values:array<double>>>"
JMH = "benchmark string, params map<string,string>, jdkVersion string, primaryMetric struct<score:double,scoreError:double,scoreUnit:string>"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The one-row header and the documents, with corpus_order for their place in the file."""
    raw = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    docs = raw.select(F.posexplode("documents").alias("corpus_order", "d")).select("corpus_order", "d.*")
    return raw.drop("documents"), docs.withColumnsRenamed({"extractedBy": "extracted_by", "manuallyValidated": "manually_validated", "abstractSha256": "abstract_sha256"})


_OUT = {"extracted_by": "extractedBy", "manually_validated": "manuallyValidated", "abstract_sha256": "abstractSha256"}


def write_corpus(docs: DataFrame, path: str, version: str = "1") -> None:
    """One document that read_corpus() reads: the header and all documents (in corpus_order, else by id), replacing what
    was there. A corpus of this format is one JSON value, put together by one task."""
    from simgrove.operators.corpus import corpus_sha256

    order = "corpus_order" if "corpus_order" in docs.columns else "id"
    own = docs.withColumnsRenamed(_OUT)
    row = F.struct(*[F.col(x.split()[0]) for x in DOCUMENT.split(", ")])
    whole = own.agg(F.count(F.lit(1)).cast("int").alias("sourceCount"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("_d")))), lambda x: x["_d"]).alias("documents"))
    whole.crossJoin(corpus_sha256(docs)).select(F.lit(version).alias("version"), "sourceCount", F.col("corpus_sha256").alias("corpusSha256"), "documents").coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_embeddings(vectors: DataFrame, path: str, corpus_version: str, corpus_sha256: str, model: str, version: str = "1") -> None:
    """A cache that read_embeddings() reads, of (id, pre_norm_l2, vec)."""
    rows = vectors.agg(F.array_sort(F.collect_list(F.struct("id", F.col("pre_norm_l2").alias("preNormL2"), F.col("vec").alias("values")))).alias("vectors"), F.max(F.size("vec")).alias("dimension"))
    head = {"version": version, "corpusVersion": corpus_version, "corpusSha256": corpus_sha256, "model": model}
    rows.select(*[F.lit(v).alias(k) for k, v in head.items()], "dimension", "vectors").coalesce(1).write.mode("overwrite").json(path)


def norm_warnings(vectors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(id, norm) of raw vectors (id, values) whose length isn't 1."""
    norm = V.norm(F.col("values"))
    return vectors.select("id", norm.alias("norm")).where(F.abs(F.col("norm") - 1) > tolerance)


def read_embeddings(spark: SparkSession, path: str, corpus_sha256: str | None = None) -> DataFrame:
    """(id, pre_norm_l2, vec) at length 1. Vectors of another dimension or corpus, not finite or zero are errors."""
    raw = spark.read.schema(CACHE).option("multiLine", True).json(path)
    head = raw.drop("vectors").first()
    if corpus_sha256 is not None and head and head["corpusSha256"] != corpus_sha256:
        raise ProblemError("embeddings-mismatch", "the vectors belong to another corpus")
    rows = raw.select("dimension", F.explode("vectors").alias("v")).select("dimension", "v.*")
    odd = (F.size("values") != F.col("dimension")) | F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checked = F.when(odd, F.raise_error(F.concat(F.lit("bad vector "), F.col("id"))).cast("array<double>")).otherwise(F.col("values"))
    return rows.select("id", F.col("preNormL2").alias("pre_norm_l2"), V.unit(checked).alias("vec"))


def read_benchmark_csv(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """The `# harness.` lines and the results; a malformed row is an error."""
    head = spark.read.text(path).where(F.col("value").startswith("# harness."))
    pairs = head.select(F.regexp_extract("value", r"# harness\.([^=:]+)[=:]\s*(.*)", 1), F.regexp_extract("value", r"# harness\.([^=:]+)[=:]\s*(.*)", 2))
    schema = "benchmark string, family string, parameter string, size double, score double, error double, unit string"
    rows = spark.read.schema(schema).option("comment", "#").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.raise_error(F.concat(F.lit(f"{c} is no number for "), "benchmark")).cast("double")).otherwise(F.col(c)).alias(c)
    numbers = ("size", "score", "error")
    return {a.strip(): b for a, b in pairs.collect()}, rows.select(*[finite(c) if c in numbers else c for c in rows.columns])


def read_jmh(spark: SparkSession, path: str) -> DataFrame:
    """Raw benchmark results; NaN errors are values, a missing metric is an error."""
    raw = spark.read.schema(JMH).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    score = F.coalesce("primaryMetric.score", F.raise_error(F.concat(F.lit("no metric: "), F.col("benchmark"))).cast("double"))
    return raw.select("benchmark", "params", "jdkVersion", score.alias("score"), F.col("primaryMetric.scoreError").alias("error"), F.col("primaryMetric.scoreUnit").alias("unit"))


def tei_header(xml) -> dict:
    """Columns title, authors, abstract of a TEI header in an XML text column; a DOCTYPE is refused."""
    at = lambda *names: "/".join(f"*[local-name()='{x}']" for x in names)
    safe = F.when(xml.contains("<!DOCTYPE"), F.raise_error(F.lit("a DOCTYPE is not allowed")).cast("string")).otherwise(xml)
    base = "//*[local-name()='teiHeader']//"
    joined = lambda p: F.array_join(F.filter(F.transform(F.xpath(safe, F.lit(p)), F.trim), lambda x: x != ""), " ")
    names = base + at("sourceDesc") + "//" + at("author", "persName") + "/*/text()"
    return {"title": F.trim(F.xpath_string(safe, F.lit(base + at("titleStmt", "title")))), "authors": F.xpath(safe, F.lit(names)), "abstract": joined(base + at("abstract") + "//" + at("p") + "/text()")}


def pdf_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path) of a folder's PDF files by name; decoding them is an extractor's work."""
    from simgrove.operators.ingest import listing

    return listing(spark, folder).select("id", "path")
