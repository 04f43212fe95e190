"""Benchmark results: families, the report's files and their checks."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.errors import ProblemError
from simgrove.operators.corpus import loglog_slopes

#: Parameters that are a size; families by class and method; the growth that theory expects.
SIZES = ["length", "n", "dimension"]
FAMILIES = {
    "LevenshteinBenchmark#pairwiseCompute": "levenshtein",
    "NeedlemanWunschBenchmark#pairwiseCompute": "needleman-wunsch",
    "JaccardBenchmark#pairwiseCompute": "jaccard",
    "TfIdfCosineBenchmark#pairwiseCompute": "tfidf-cosine",
    "LanceWilliamsBenchmark#agglomerate": "hac",
    "InternalMetricsBenchmark#meanSilhouette": "mean-silhouette",
    "InternalMetricsBenchmark#daviesBouldin": "davies-bouldin",
    "EmbeddingPrimitiveBenchmark#dotProduct": "embedding-dot-product",
    "EmbeddingPrimitiveBenchmark#euclideanSumOfSquaredDifferences": "embedding-euclidean-sum-squared",
    "ClassicPairwiseSloBenchmark#allPairsForAlgorithm": "slo-classic",
    "ClusteringSloBenchmark#allFourLinkages": "slo-clustering",
}
EXPONENTS = {"levenshtein": 2.0, "needleman-wunsch": 2.0, "jaccard": 1.0, "tfidf-cosine": 1.0, "hac": 3.0, "mean-silhouette": 2.0, "davies-bouldin": 1.0, "embedding-dot-product": 1.0, "embedding-euclidean-sum-squared": 1.0}
#: The report's keys and columns.
HARNESS = ["cpuModel", "logicalCores", "totalRamBytes", "jdk", "os", "utcDate"]
RESULTS = "benchmark,family,parameter,size,score,error,unit"
SLOPES = "family,points,empiricalSlope,theoreticalExponent"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def classified(results: DataFrame) -> DataFrame:
    """Results (benchmark, params, ...) with family, parameter, size and theoretical_exponent (null if none is expected),
    or with `problem` where a result has no class, or not one numeric size."""
    parts = F.split("benchmark", r"\.")
    owner, method = F.get(parts, F.size(parts) - 2), F.element_at(parts, -1)
    base = F.coalesce(F.try_element_at(_map(FAMILIES), F.concat_ws("#", owner, method)), F.concat_ws(".", owner, method))
    present = F.filter(F.array(*map(F.lit, SIZES)), lambda k: F.map_contains_key("params", k))
    key = F.get(present, F.lit(0))
    value = F.try_element_at(F.col("params"), key)
    others = F.transform(F.filter(F.array_sort(F.map_entries("params")), lambda e: e["key"] != key), lambda e: e["value"])
    problem = F.when(F.size(parts) < 2, "not a qualified name").when(F.size(present) == 0, "no size").when(F.size(present) > 1, "several sizes").when(~value.rlike(_NUMBER), "a size that is no number")
    family = F.concat_ws("-", base, F.when(F.size(others) > 0, F.array_join(others, "-")))
    return results.withColumns({"family": family, "parameter": key, "size": F.when(value.rlike(_NUMBER), value.cast("double")), "theoretical_exponent": F.try_element_at(_map(EXPONENTS), base), "problem": problem})


def export_ready(results: DataFrame) -> DataFrame:
    """Classified results; all that can't be classified are named in one error."""
    rows = classified(results)
    bad = rows.where("problem is not null").select(F.concat_ws(": ", "benchmark", "problem").alias("p")).orderBy("p").limit(1000).collect()
    if bad:
        raise ProblemError("unclassified-results", "; ".join(r.p for r in bad))
    return rows.drop("problem")


def slopes(rows: DataFrame) -> DataFrame:
    """family, points, empirical_slope, theoretical_exponent of families with an expected growth, by name."""
    known = rows.where("theoretical_exponent is not null")
    return loglog_slopes(known.select("family", "size", "score"), known.select("family", "theoretical_exponent").distinct()).orderBy("family")


def jdk_of(version: Column) -> Column:
    """The last word of a reported version."""
    return F.regexp_extract(F.coalesce(version, F.lit("")), r"(\S+)\s*$", 1)


def reported_jdk(results: DataFrame) -> str | None:
    """The first JDK version that a result reports."""
    return results.agg(F.first("jdkVersion", ignorenulls=True)).first()[0]


# ---- the report's files: a few lines each, written and read by the driver ----


def _write(path: str, lines: list[str]) -> None:
    """All or nothing: a new file takes the place of the old one."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8", newline="\n") as f:
        f.write("".join(x + "\n" for x in lines))
    os.replace(path + ".part", path)


def write_results(rows: DataFrame, harness: dict[str, str], path: str) -> None:
    columns = ["benchmark", "family", "parameter", "size", "score", "error", "unit"]
    table = rows.select(*[F.col(c).cast("string") for c in columns]).collect()  # a row for each benchmark
    _write(path, [*[f"# harness.{k} = {harness[k]}" for k in HARNESS], RESULTS, *[",".join(r) for r in table]])


def write_slopes(rows: DataFrame, path: str) -> None:
    table = slopes(rows).select("family", "points", "empirical_slope", "theoretical_exponent").collect()
    _write(path, [SLOPES, *[f"{f},{n},{s:.6f},{t:.6f}" for f, n, s, t in table]])


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_sidecar(harness: dict[str, str], path: str, results_json: str | None = None) -> None:
    """key=value lines, with the hash of the results file that they belong to."""
    _write(path, [*[f"{k}={harness[k]}" for k in HARNESS], *([f"jmhResultsSha256={file_sha256(results_json)}"] if results_json else [])])


def read_sidecar(path: str, results_json: str | None = None) -> dict[str, str]:
    """The fields; a missing one, or another hash than the results file's, is an error."""
    with open(path, encoding="utf-8") as f:
        found = dict(x.rstrip("\n").split("=", 1) for x in f if "=" in x)
    if gone := [k for k in HARNESS if k not in found]:
        raise ProblemError("bad-report", f"{path} lacks {', '.join(gone)}")
    if results_json and found.get("jmhResultsSha256") != file_sha256(results_json):
        raise ProblemError("bad-report", f"{path} belongs to another results file")
    return found


def read_report(spark: SparkSession, results_path: str, slopes_path: str) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """Harness, results and slopes. Unknown, missing or repeated header keys, another column header, another number of
    columns, blanks and numbers that aren't finite decimals are errors, as are files without rows."""

    def fail(path, why):
        raise ProblemError("bad-report", f"{path}: {why}")

    def table(path, header, kinds, lines):
        if not lines or lines[0] != header:
            fail(path, f"the column header isn't {header!r}")
        rows = []
        for line in filter(str.strip, lines[1:]):
            cells = line.split(",")
            if len(cells) != len(kinds):
                fail(path, f"{len(cells)} columns in {line!r}")
            for cell, kind in zip(cells, kinds, strict=True):
                if kind is str and not cell.strip():
                    fail(path, f"a blank in {line!r}")
                if kind is not str and not re.match(_NUMBER if kind is float else r"^[+-]?\d+$", cell) or kind is float and abs(float(cell)) == float("inf"):
                    fail(path, f"{cell!r} is no number")
            rows.append(tuple(kind(cell) for cell, kind in zip(cells, kinds, strict=True)))
        return rows or fail(path, "no rows")

    def lines_of(path):
        try:
            with open(path, encoding="utf-8") as f:
                return f.read().splitlines()
        except (OSError, UnicodeDecodeError) as e:
            fail(path, e)

    lines, harness = lines_of(results_path), {}
    while lines and lines[0].startswith("#"):
        m = re.match(r"#\s*harness\.(\w+)\s*=\s*(.*)", lines.pop(0))
        if not m or m[1] not in HARNESS or m[1] in harness or not m[2].strip():
            fail(results_path, "a header line is unknown, repeated or blank")
        harness[m[1]] = m[2].strip()
    if gone := [k for k in HARNESS if k not in harness]:
        fail(results_path, f"no header line for {', '.join(gone)}")
    results = table(results_path, RESULTS, [str, str, str, float, float, float, str], lines)
    found = table(slopes_path, SLOPES, [str, int, float, float], lines_of(slopes_path))
    schema = "benchmark string, family string, parameter string, size double, score double, error double, unit string"
    return harness, spark.createDataFrame(results, schema), spark.createDataFrame(found, "family string, points long, empirical_slope double, theoretical_exponent double")
