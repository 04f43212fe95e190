"""From a folder of files to a corpus: listing, metadata from text, the choice between attempts, ids and hashes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simgrove.errors import ProblemError
from simgrove.functions.text import clean, padded_id, quality_reasons, trimmed
from simgrove.operators.corpus import text_sha256

#: Characters after which no more lines of an abstract are taken.
MOST_CHARS = 4000
#: What begins an abstract and what ends it, a word in spaced letters, what stands between authors.
HEADING = r"(?i)^abstract\s*[:.\-]?\s*(.*)$"
NEXT_SECTION = r"(?i)^(keywords|index terms|introduction|1\.?\s*introduction|i\.?\s*introduction|1\.)\b.*$"
SPACED_WORD = r"^(?:\p{L}\s){3,}\p{L}$"
AUTHOR_SEPARATOR = r",|\band\b|&"


def author_names(line: Column) -> Column:
    """The names of a line of authors."""
    return F.filter(F.transform(F.split(line, AUTHOR_SEPARATOR), trimmed), lambda x: x != "")


def text_metadata(text: Column) -> dict[str, Column]:
    """title, authors and abstract of an extracted text: its first line, the names of its second one, and the lines from
    the heading of the abstract to that of the next section or up to MOST_CHARS. Null text: all empty."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), trimmed)
    full = F.filter(lines, lambda x: x != "")
    heading = lambda x: x.rlike(HEADING)
    at = F.array_position(F.transform(full, heading), F.lit(True))
    first = F.regexp_extract(F.coalesce(F.get(full, (at - 1).cast("int")), F.lit("")), HEADING, 1)
    rest = F.when(at > 0, F.slice(full, (at + 1).cast("int"), F.size(full))).otherwise(F.array().cast("array<string>"))
    plain = lambda x: F.when(x.rlike(SPACED_WORD), F.regexp_replace(x, " ", "")).otherwise(x)
    end = F.array_position(F.transform(rest, lambda x: plain(x).rlike(NEXT_SECTION)), F.lit(True))
    body = F.when(end > 0, F.slice(rest, 1, (end - 1).cast("int"))).otherwise(rest)
    start = F.when(first != "", F.concat(first, F.lit("\n"))).otherwise("")
    taken = F.aggregate(body, start, lambda a, x: F.when(F.length(a) < MOST_CHARS, F.concat(a, x, F.lit("\n"))).otherwise(a))
    authors = F.coalesce(author_names(F.get(full, F.lit(1))), F.array().cast("array<string>"))
    return {"title": clean(F.coalesce(F.get(full, F.lit(0)), F.lit(""))), "authors": authors, "abstract": clean(F.when(at > 0, taken).otherwise(""))}


def chosen_attempt(primary: Column, fallback: Column) -> Column:
    """`primary` or `fallback`, of two abstracts (null or blank: not usable): the first if nothing speaks against it, the
    only usable one, else the better of both; null if neither is usable."""
    usable = lambda x: trimmed(x) != ""
    a, b = quality_reasons(primary), quality_reasons(fallback)
    better = F.when(F.size(a) == 0, "primary").when(F.size(b) == 0, "fallback").when(F.length(trimmed(fallback)) > F.length(trimmed(primary)), "fallback").otherwise("primary")
    return F.when(usable(primary) & usable(fallback), better).when(usable(primary), "primary").when(usable(fallback), "fallback")


def quality_line(doc_id: Column, extracted_by: Column, abstract: Column) -> Column:
    """A document's line in the summary of an ingestion."""
    reasons = quality_reasons(abstract)
    status = F.when(F.size(reasons) > 0, F.concat(F.lit("suspicious: "), F.array_join(reasons, "; "))).otherwise("ok")
    return F.concat(F.lit("  "), doc_id, F.lit(" ["), extracted_by, F.lit("] "), F.length(abstract).cast("string"), F.lit(" chars - "), status)


def listing(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(id, name, path, content) of a folder's own files with the suffix, in any case, numbered by name. Only names are
    put in order; contents are read where they are used."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")
    names = files.select("name").withColumn("n", F.row_number().over(Window.orderBy("name"))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    return files.join(names.select("name", padded_id(F.col("n"), F.col("total")).alias("id")), "name").select("id", "name", "path", "content")


#: An extractor: the bytes of a file to its text.
TextExtractor = Callable[[bytes], str]


def extracted(files: DataFrame, extractor: TextExtractor, column: str = "text") -> DataFrame:
    """The files (id, name, path, content) with their text in place of the content; a file that the extractor fails on
    has null. The extractor runs in the executors, a batch of files at a time."""

    def run(batches):
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(extractor(bytes(content)))
                except Exception:  # noqa: BLE001  whatever a plug-in raises is a failed attempt
                    texts.append(None)
            yield pd.DataFrame({"id": batch["id"], "name": batch["name"], "path": batch["path"], column: texts})

    return files.select("id", "name", "path", "content").mapInPandas(run, f"id string, name string, path string, {column} string")


def ingest(spark: SparkSession, folder: str, primary: TextExtractor, fallback: TextExtractor | None = None, names: tuple[str, str] = ("primary", "fallback"), suffix: str = "pdf") -> DataFrame:
    """The documents of a folder: id, title, authors, abstract, source, extracted_by, manually_validated (false) and
    abstract_sha256. A folder without files is an error, as is a file that no extractor finds an abstract in."""
    files = listing(spark, folder, suffix)
    if not files.limit(1).count():
        raise ProblemError("empty-folder", f"{folder} holds no .{suffix} files")
    base = folder.replace("\\", "/").rstrip("/")
    sides = extracted(files, primary, "text_a")
    if fallback is not None:
        sides = sides.join(extracted(files, fallback, "text_b").select("id", "text_b"), "id")
    else:
        sides = sides.withColumn("text_b", F.lit(None).cast("string"))
    a, b = text_metadata(F.col("text_a")), text_metadata(F.col("text_b"))
    rows = sides.select("id", "name", F.struct(*[c.alias(k) for k, c in a.items()]).alias("a"), F.struct(*[c.alias(k) for k, c in b.items()]).alias("b"))
    rows = rows.withColumn("which", chosen_attempt(F.col("a.abstract"), F.col("b.abstract")))
    failed = F.raise_error(F.concat(F.lit("no extractor finds an abstract in "), F.col("name")))
    rows = rows.withColumn("m", F.when(F.col("which") == "primary", F.col("a")).when(F.col("which") == "fallback", F.col("b")).otherwise(failed.cast("struct<title:string,authors:array<string>,abstract:string>")))
    by = F.when(F.col("which") == "primary", names[0]).otherwise(names[1])
    return rows.select("id", "m.*", F.concat(F.lit(base + "/"), "name").alias("source"), by.alias("extracted_by"), F.lit(False).alias("manually_validated"), text_sha256(F.col("m.abstract")).alias("abstract_sha256"))


#: An embedder: texts to vectors of one length.
Embedder = Callable[[list[str]], list]


def embedded(docs: DataFrame, embedder: Embedder, dimension: int, text: str = "abstract", batch: int = 64) -> DataFrame:
    """(id, pre_norm_l2, values) with unit vectors of (id, text). The embedder runs in the executors on `batch` texts at
    a time; another number or length of vectors than asked for is an error, as is one without direction."""

    def run(frames):
        import numpy as np

        for frame in frames:
            for s in range(0, len(frame), batch):
                part = frame.iloc[s : s + batch]
                v = np.asarray(embedder(part[text].fillna("").tolist()), float)
                if v.shape != (len(part), dimension):
                    raise ValueError(f"the embedder gave {v.shape} for {len(part)} texts of dimension {dimension}")
                norm = np.sqrt((v * v).sum(1))
                if not (np.isfinite(norm) & (norm > 0)).all():
                    raise ValueError("the embedder gave a vector that is zero or not finite")
                yield pd.DataFrame({"id": part["id"], "pre_norm_l2": norm, "values": list(v / norm[:, None])})

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", text).mapInPandas(run, f"id {kind}, pre_norm_l2 double, values array<double>")
