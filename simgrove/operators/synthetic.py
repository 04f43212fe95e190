"""Inputs for benchmarks: unit vectors, token sequences and distances from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.errors import ProblemError
from simgrove.functions import vectors as V


def unit_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 0) -> DataFrame:
    """(obs, vec): components uniform in [-1, 1), scaled to length 1; a component depends on seed, row and place alone."""
    if n < 1 or dimension < 1:
        raise ProblemError("invalid-request", "a size below 1")
    draw = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), k), 11).cast("double") / float(1 << 52) - 1
    rows = spark.range(n).select(F.col("id").alias("obs"), F.transform(F.sequence(F.lit(1), F.lit(dimension)), draw).alias("vec"))
    return rows.select("obs", V.unit(F.col("vec")).alias("vec"))


def token_pool(docs: DataFrame, order: str = "id") -> DataFrame:
    """(place, token): the tokens of all documents (id, tokens), one after the other."""
    return docs.select(order, F.posexplode("tokens").alias("pos", "token")).select(F.struct(order, "pos").alias("place"), "token")


def token_sequences(pool: list[str], length: int, seed: int = 0) -> tuple[list[str], list[str]]:
    """Two sequences from a pool that is walked in circles: from place seed mod size, and from half a pool further."""
    if not pool or length < 0:
        raise ProblemError("invalid-request", "an empty pool or a length below 0")
    n = len(pool)
    first = seed % n
    second = (first + n // 2) % n
    return [pool[(first + i) % n] for i in range(length)], [pool[(second + i) % n] for i in range(length)]


def cosine_distances(spark: SparkSession, n: int, dimension: int, seed: int = 0) -> DataFrame:
    """(i, j, d) of unit_vectors()."""
    from simgrove.operators.clustering import cosine_distances as distances

    return distances(unit_vectors(spark, n, dimension, seed))
