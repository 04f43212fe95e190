"""Corpus integrity: hashes, the freeze, the twelve rules, coverage of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simgrove.errors import ProblemError
from simgrove.functions.text import tokens, trimmed


def text_sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def corpus_sha256(docs: DataFrame) -> DataFrame:
    """corpus_sha256 of (id, abstract_sha256): the hash of the `id:sha` lines in id order, a row even of no documents.

    One digest is made by one task; it reads the sorted lines as a stream, so that they never lie in memory at once."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        digest = hashlib.sha256()
        for batch in batches:
            digest.update("".join(f"{x}\n" for x in batch.column("line").to_pylist()).encode())
        yield pa.record_batch({"corpus_sha256": [digest.hexdigest()]})

    lines = docs.select(F.concat_ws(":", F.col("id"), F.col("abstract_sha256")).alias("line"))
    if not lines.limit(1).count():
        return docs.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("corpus_sha256"))
    return lines.orderBy("line").coalesce(1).mapInArrow(run, "corpus_sha256 string")


def validate(docs: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Documents named (all if None) become validated with fresh hashes; an unknown id or an empty list is an error."""
    if ids is not None:
        if not ids:
            raise ProblemError("invalid-selection", "no document is named")
        known = {r[0] for r in docs.where(F.col("id").isin(ids)).select("id").distinct().collect()}
        if gone := sorted(set(ids) - known):
            raise ProblemError("unknown-document", ", ".join(gone))
    chosen = F.lit(True) if ids is None else F.col("id").isin(ids)
    return docs.withColumn("manually_validated", F.when(chosen, F.lit(True)).otherwise(F.col("manually_validated"))).withColumn("abstract_sha256", F.when(chosen, text_sha256(F.col("abstract"))).otherwise(F.col("abstract_sha256")))


def verify(docs: DataFrame, source_count: int | None = None, expected: int | None = None, stored_sha256: str | None = None) -> DataFrame:
    """All violations in one pass: rule, document_id (null for the corpus's own), message.

    docs: id, title, authors, abstract, manually_validated, abstract_sha256."""
    blank = lambda c: trimmed(F.col(c)) == ""
    many = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) > 1
    df = docs.withColumn("_ids", many("id")).withColumn("_shas", many("abstract_sha256"))
    rules = [
        ("UNIQUE_DOCUMENT_ID", F.col("_ids")), ("NO_DUPLICATE_ABSTRACT_SHA256", F.col("_shas")), ("NON_BLANK_TITLE", blank("title")),
        ("NON_EMPTY_AUTHORS", F.coalesce(F.size("authors"), F.lit(0)) < 1), ("NON_BLANK_ABSTRACT", blank("abstract")), ("MANUALLY_VALIDATED", ~F.coalesce("manually_validated", F.lit(False))),
        ("NON_EMPTY_PREPROCESSED_TOKENS", ~blank("abstract") & (F.size(tokens(F.col("abstract"))) == 0)),
        ("ABSTRACT_SHA256_MATCHES_RECOMPUTED", ~blank("abstract") & ~F.col("abstract_sha256").eqNullSafe(text_sha256(F.col("abstract")))),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    out = df.select(F.col("id").cast("string").alias("document_id"), F.explode_outer(found).alias("rule")).where("rule is not null")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    wide = [("MINIMUM_DOCUMENT_COUNT", F.col("n") < 3)]
    if source_count is not None:
        wide.append(("DOCUMENT_COUNT_MATCHES_SOURCE_COUNT", F.col("n") != source_count))
    if expected is not None:
        wide.append(("DOCUMENT_COUNT_MATCHES_EXPECTED", F.col("n") != expected))
    total = n.select(F.lit(None).cast("string").alias("document_id"), F.explode_outer(F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in wide]))).alias("rule")).where("rule is not null")
    out = out.unionByName(total)
    if stored_sha256 is not None:
        own = corpus_sha256(docs).where(F.col("corpus_sha256") != stored_sha256)
        out = out.unionByName(own.select(F.lit(None).cast("string").alias("document_id"), F.lit("CORPUS_SHA256_MATCHES_RECOMPUTED").alias("rule")))
    return out.select("rule", "document_id", F.concat_ws(": ", F.lower(F.regexp_replace("rule", "_", " ")), "document_id").alias("message"))


def coverage(doc_ids: DataFrame, vector_ids: DataFrame) -> DataFrame:
    """(id, problem): missing, unexpected and duplicate vectors."""
    say = lambda df, x: df.select("id", F.lit(x).alias("problem"))
    twice = vector_ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return say(doc_ids.join(vector_ids, "id", "left_anti"), "missing").unionByName(say(vector_ids.join(doc_ids, "id", "left_anti").distinct(), "unexpected")).unionByName(say(twice, "duplicate"))


def better_of(a_text: Column, a_reasons: Column, b_text: Column, b_reasons: Column) -> Column:
    """The abstract without reasons against it; else the longer one, trimmed; else the first."""
    a_ok, b_ok = F.size(a_reasons) == 0, F.size(b_reasons) == 0
    return F.when(a_ok, a_text).when(b_ok, b_text).when(F.length(F.trim(b_text)) > F.length(F.trim(a_text)), b_text).otherwise(a_text)


def loglog_slopes(results: DataFrame, exponents: DataFrame) -> DataFrame:
    """family, points, empirical_slope, theoretical_exponent of (family, size, score) with two sizes or more."""
    ok = results.where("size > 0 and score > 0")
    fits = ok.groupBy("family").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("size").alias("sizes"), F.regr_slope(F.log("score"), F.log("size")).alias("empirical_slope"))
    return fits.where("points >= 2 and sizes >= 2").drop("sizes").join(exponents, "family")
