"""Operator 4: best-fit decreasing packing.

Documents are cut into full windows and a rest; rests, longest first, go to the open window with the least room that
still takes them. A segment tree over the remaining capacities (0 to WINDOW) counts the open windows of each capacity,
so the tightest one is found in log2(WINDOW) steps, whatever the number of windows.

Each task packs its own partition in bins of bounded size, without a shuffle. Windows that a bin leaves with room for
more than SLACK ids are taken apart again and their pieces packed together, across tasks, so that the padding doesn't
grow with the number of partitions. A sequence's number holds the task's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import bounded_batches, slices, stored, text_bytes, text_of, trim
from simgrove.llm.tokens import GROUP_BYTES, encoder, vocabulary

WINDOW, END = 1024, 0
#: Ids that a task holds before it packs and emits them.
HELD_IDS = 8_000_000
#: Room that a window may keep after its bin.
SLACK = 16
#: Sequences of the second packing count from here on.
SECOND = 1 << 60
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Capacities:
    """A segment tree with the number of open windows at each remaining capacity."""

    def __init__(self, window: int = WINDOW):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The open window with the least capacity of size or more, and that capacity; it is no longer open."""
        i = size + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Each piece's window and offset, and the number of windows. Equal sizes keep their order."""
    place, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    caps, n = Capacities(window), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = caps.take(size)
        if found is None:
            found = (n, window)
            n += 1
        w, room = found
        place[k], offset[k] = w, window - room
        caps.put(room - size, w)
    return place, offset, n


def _packed(path: str, end: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tok, task = encoder(path), TaskContext.get().partitionId()
        sequence = task << 36
        held: list = []
        n = 0

        def pack():
            nonlocal held, n, sequence
            docs = [d for h in held for d in h[0]]
            ids, total = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            pieces = -(-total // WINDOW)
            doc = np.repeat(np.arange(len(docs)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW
            length = np.minimum(WINDOW, total[doc] - start)
            at = np.repeat(np.cumsum(total) - total, pieces) + start
            where, offset, windows = best_fit_decreasing(length)
            loose = WINDOW - np.bincount(where, length, windows) > SLACK
            raw = ids.astype("<u4", copy=False).tobytes()
            for s in range(0, len(doc), 2000):
                e = slice(s, s + 2000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[x] for x in doc[e]], pa.int64()), pa.array(start[e]), pa.array(length[e]), pa.array(total[doc[e]]), pa.array(sequence + where[e]), pa.array(offset[e]), pa.array([raw[4 * x : 4 * (x + m)] for x, m in zip(at[e].tolist(), length[e].tolist(), strict=True)], pa.binary()), pa.array(loose[where[e]])],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "loose"],
                )
            held, n, sequence = [], 0, sequence + windows

        for batch in batches:
            (raw, at), docs = text_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in slices(at, GROUP_BYTES):
                ids, sizes = tok.encode_bytes(raw[at[a] : at[b]], at[a : b + 1] - at[a], end)
                held.append((docs[a:b], ids, sizes))
                n += len(ids)
                if n >= HELD_IDS:
                    yield from pack()
        if held:
            yield from pack()
        trim()

    return run


def _again(batches):
    """Pieces of loose windows, packed once more."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    sequence, held, n = SECOND + (TaskContext.get().partitionId() << 36), [], 0
    names = [x.split()[0] for x in PIECES.split(", ")]

    def pack():
        table = pa.Table.from_batches(held)
        where, offset, windows = best_fit_decreasing(table.column("length").to_numpy())
        table = table.set_column(names.index("sequence_id"), "sequence_id", pa.array(sequence + where)).set_column(names.index("offset"), "offset", pa.array(offset))
        return table.to_batches(2000), windows

    for batch in batches:
        held.append(batch.select(names))
        n += pc.sum(batch.column("length")).as_py() or 0
        if n >= HELD_IDS:
            out, windows = pack()
            yield from out
            sequence, held, n = sequence + windows, [], 0
    if held:
        yield from pack()[0]


def pack(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """PIECES rows: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32 bits) of every piece.

    Null texts are the end id alone; null and repeated doc_ids are packed row by row; equal lengths keep their order; no
    rows, no pieces. A very long text's ids are held whole by its task. Other columns aren't read, whatever their names."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    first = stored(rows.mapInArrow(_packed(path, end), PIECES + ", loose boolean"))
    rest = first.where("loose").drop("loose")
    tasks = -(-(rest.agg(F.sum("length")).first()[0] or 0) // HELD_IDS) or 1
    again = rest.repartition(tasks, "doc_id", "start").sortWithinPartitions("doc_id", "start").mapInArrow(_again, PIECES)
    return first.where("not loose").drop("loose").unionByName(again)


def op4_best_fit_decreasing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place and checksum."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
