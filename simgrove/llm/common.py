"""Shared plumbing: the folder all executors see, files in it, digests of words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of rows that Spark hands to Python at once.
ARROW_BYTES = "16m"
#: A table of at most so many bytes, as rows in memory, may be broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 16_000_000
#: Copies of a key's row that a shuffled join deals a hot key's other rows to.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """A new name in the folder that the session's spark.checkpoint.dir names. A master on this machine may do without:
    then a temporary folder is named there; on a cluster, where others couldn't read it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="simgrove-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    path = shared_dir(df.sparkSession) + ".parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_of(df: DataFrame) -> Column:
    """The bytes of a row's values, and 16 for each."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(4 * F.length(F.to_json(F.struct(F.col(name)))), F.lit(0))
    return total


def small(df: DataFrame) -> DataFrame:
    """The frame, with a broadcast hint if its rows take few enough bytes; else for a shuffled join. It is read once
    for that, so it should be a table or columns of one."""
    size = df.agg(F.sum(_bytes_of(df))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def with_few(df: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """df joined with a frame of unique keys, broadcast where its bytes allow. Beyond that df's rows are dealt by key and
    salt to SALTS copies of the frame, so that a hot key's rows don't meet in one task."""
    few = stored(few)
    near = small(few)
    if near is not few:
        return df.join(near, key, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], how).drop("_salt")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---- files in the shared folder, written and read by executors ----


def _fs(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file whose name no other attempt uses; a manifest row committed by Spark says which files count."""
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    full = f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(full) as out:
        out.write(data)
    return f"{folder.rstrip('/')}/{full.rsplit('/', 1)[1]}"


def open_file(path: str):
    """A file of the shared folder as a stream."""
    fs, local = _fs(path)
    return fs.open_input_stream(local)


def map_array(path: str, dtype) -> np.ndarray:
    """A file of numbers as a memory map; where the shared folder can't be mapped, its bytes are fetched."""
    fs, local = _fs(path)
    if type(fs).__name__ == "LocalFileSystem":
        return np.memmap(local, dtype, mode="r") if os.path.getsize(local) else np.empty(0, dtype)
    with fs.open_input_stream(local) as src:
        return np.frombuffer(src.read(), dtype)


# ---- 64-bit numbers ----

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
#: A random number for each byte; A-Z count as a-z.
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_LETTERS[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at a time, which fit a cache.
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, one text after the other, and the n + 1 places between."""
    import pyarrow as pa

    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def spans(raw: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that are no white space begin and end; texts' ends end them too."""
    word = ~space[raw]
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = at[(at > 0) & (at < len(raw))]
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, letters: np.ndarray = _LETTERS) -> np.ndarray:
    """64-bit hashes of stretches of bytes in ascending order: sums of letters times powers of an odd base, by prefix
    sums, scrambled with the length."""
    out = np.empty(len(begins), np.uint64)
    first = 0
    while first < len(begins):
        a = int(begins[first])
        last = int(np.searchsorted(ends, a + _STEP, "right"))
        if last <= first:  # a stretch beyond _STEP, in parts
            total, b = 0, int(ends[first])
            for x in range(a, b, _STEP):
                y = min(b, x + _STEP)
                total += int((letters[raw[x:y]] * _UP[: y - x]).sum()) * pow(_BASE, x - a, 1 << 64)
            out[first] = total & 0xFFFFFFFFFFFFFFFF
            first += 1
            continue
        n = int(ends[last - 1]) - a
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[raw[a : a + n]] * _UP[:n], out=sums[1:])
        s = begins[first:last] - a
        out[first:last] = (sums[ends[first:last] - a] - sums[s]) * _DOWN[s]
        first = last
    out += (ends - begins).astype(np.uint64) * _GOLD
    return mix64(out)


def hashed_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words [^\\x20\\x09-\\x0D]+ of texts, with A-Z lower-cased, and each text's number of words."""
    begins, ends = spans(raw, at)
    return hash_spans(raw, begins, ends), np.diff(np.searchsorted(begins, at))


def slices(at: np.ndarray, size: int):
    """(first, last) of stretches of texts of at most so many bytes; a longer text stands alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last
        first = last


def trim() -> None:
    """Give freed pages back at once: workers wait beside the next stage."""
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


class Kept(dict):
    """What operators keep in a worker process from task to task. Spark hands a worker on from stage to stage, so what
    one operator kept is freed before another fills its own."""

    def of(self, name: str, make):
        if name not in self:
            self.free()
            self[name] = make()
        return self[name]

    def free(self) -> None:
        if self:
            self.clear()
            trim()


kept = Kept()


#: str.translate table that lower-cases A-Z alone.
LOWER_AZ = {c: c + 32 for c in range(65, 91)}


def lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER_AZ)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values: np.unique by a sort, which is many times faster than its hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each stretch, one stretch after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)
