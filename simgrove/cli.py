"""The corpus's commands: `python -m simgrove ingest | validate | verify`. Each returns 0, or 1 if it fails.

A corpus is a path that read_corpus() reads. Plug-ins are named as module:function.
"""

from __future__ import annotations

import argparse
import sys
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.operators import corpus as Q
from simgrove.operators import ingest as I
from simgrove.sources.files import read_corpus, write_corpus

CORPUS = "data/corpus.json"


def _plugin(name: str | None):
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def replace_corpus(spark: SparkSession, docs: DataFrame, path: str, version: str) -> None:
    """Writes the corpus beside its path and puts it in its place only when it is whole, as docs may be read from there."""
    jvm = spark.sparkContext._jvm
    place, fresh, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    write_corpus(docs, fresh.toString(), version)
    files.delete(old, True)
    if files.exists(place) and not files.rename(place, old):
        raise OSError(f"{path} can't be moved away")
    if not files.rename(fresh, place):
        raise OSError(f"{path} can't be put in place; what was there is at {old.toString()}")
    files.delete(old, True)


def ingest(spark: SparkSession, given) -> int:
    primary, fallback = _plugin(given.extractor), _plugin(given.fallback)
    docs = I.ingest(spark, given.input, primary, fallback, (given.extractor, given.fallback or ""), given.suffix).persist()
    try:
        replace_corpus(spark, docs, given.output, "1.0")
        print(f"Ingested {docs.count()} document(s) from {given.input} into {given.output}")
        lines = docs.select("id", F.format_string("  %s [%s] %s", "id", "extracted_by", "title").alias("line"), I.quality_line(F.col("id"), F.col("extracted_by"), F.col("abstract")).alias("quality")).orderBy("id")
        for r in lines.toLocalIterator():
            print(r.line)
        print("No document is validated yet; review each abstract, then run validate.\nAbstract quality:")
        for r in lines.toLocalIterator():
            print(r.quality)
    finally:
        docs.unpersist()
    return 0


def validate(spark: SparkSession, given) -> int:
    if not given.all and given.ids is None:
        raise ValueError("validate needs --ids=d01,d02 or --all")
    head, docs = read_corpus(spark, given.corpus)
    ids = None if given.all else [x.strip() for x in given.ids.split(",") if x.strip()]
    replace_corpus(spark, Q.validate(docs, ids), given.corpus, head.first()["version"])
    n = read_corpus(spark, given.corpus)[1].agg(F.count_if("manually_validated").alias("valid"), F.count(F.lit(1)).alias("all")).first()
    print(f"Validated. {n['valid']}/{n['all']} document(s) are validated in {given.corpus}")
    return 0


def verify(spark: SparkSession, given) -> int:
    head, docs = read_corpus(spark, given.corpus)
    head = head.first()
    found = Q.verify(docs, head["sourceCount"], given.expected, head["corpusSha256"]).persist()
    try:
        n = found.count()
        print(f"verify: OK ({given.corpus})" if not n else f"verify: {n} violation(s) in {given.corpus}", file=sys.stderr if n else sys.stdout)
        for r in found.orderBy("rule", "document_id").toLocalIterator():
            print(f"  [{r.document_id or 'corpus'}] {r.rule}: {r.message}", file=sys.stderr)
    finally:
        found.unpersist()
    return 1 if n else 0


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("simgrove")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest")
    p.set_defaults(run=ingest)
    for name, value in (("input", "data/pdfs"), ("output", CORPUS), ("suffix", "pdf"), ("fallback", None)):
        p.add_argument(f"--{name}", default=value)
    p.add_argument("--extractor", required=True)
    p = commands.add_parser("validate")
    p.set_defaults(run=validate)
    p.add_argument("--corpus", default=CORPUS)
    p.add_argument("--ids")
    p.add_argument("--all", action="store_true")
    p = commands.add_parser("verify")
    p.set_defaults(run=verify)
    p.add_argument("--corpus", default=CORPUS)
    p.add_argument("--expected", type=int)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = arguments().parse_args(args)
    spark = spark or SparkSession.builder.appName("simgrove").getOrCreate()
    try:
        return given.run(spark, given)
    except Exception as e:  # noqa: BLE001  a command says why it fails
        print(f"{given.command} failed: {e}", file=sys.stderr)
        return 1
