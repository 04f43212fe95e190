"""Operator 5: chat formatting at the level of tokens.

Every turn becomes TURN role ROLE_END text TURN_END. Role and text are encoded apart from everything else, and the
three reserved ids, which no text encodes to, are spliced between them; a turn's places in its conversation and the
stretch under the loss mask are prefix sums of the segments' lengths. Read as text, the reserved ids are the control
strings below. Where one occurs inside a text, a backslash goes into it, and backslashes are doubled, so unescaping
gives back every text.

Turns are put in order by a range of conversation and turn, so that a conversation that holds a third of all turns is
dealt to several tasks; each formats its stretch in bounded parts, and the sums of the stretches of such conversations
(a row for each task) say where in its conversation each begins. Reading back streams a conversation's parts through
one hash, in order, which only one task can do.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simgrove.llm.common import bounded_batches, stored
from simgrove.llm.tokens import encoder, vocabulary

#: Reserved ids, beyond the vocabulary, and the strings that stand for them.
TURN, ROLE_END, TURN_END = 60_000, 60_001, 60_002
SURFACE = {TURN: "### ", ROLE_END: ": ", TURN_END: " </turn>\n"}
#: Ids in a part of a conversation's output.
PART = 100_000
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|:(?= )")
PARTS = "conv_id long, part long, start long, turns long, ids binary, loss_mask binary"


def escape(text: str) -> str:
    """The text with backslashes doubled and a backslash inside of `###` and `</turn>`."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def escape_role(role: str) -> str:
    """The same, and a backslash inside of `: ` too, which ends a role."""
    return _ROLE_CONTROL.sub(lambda m: m[0] + "\\", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _id_bytes(tokenizer) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary: its letters stand for bytes, the printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
    return {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in tokenizer.get_vocab().items()}


_BYTES: dict = {}


def _decoder(path: str) -> dict[int, bytes]:
    if path not in _BYTES:
        _BYTES[path] = _id_bytes(encoder(path, plain=True).tokenizer) | {k: v.encode() for k, v in SURFACE.items()}
    return _BYTES[path]


def read_surface(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation that reads as text."""
    turns, at = [], 0
    while at < len(text):
        mid = text.index(SURFACE[ROLE_END], at)
        end = text.index(SURFACE[TURN_END], mid)
        turns.append((unescape(text[at + len(SURFACE[TURN]) : mid]), unescape(text[mid + len(SURFACE[ROLE_END]) : end])))
        at = end + len(SURFACE[TURN_END])
    return turns


def _formatted(path: str):
    """Turns in order -> parts, with the task; a part's number and start count from the task's first turn of it."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tok, task = encoder(path, plain=True), TaskContext.get().partitionId()  # a special token's string is text
        if tok.tokenizer.get_vocab_size() > TURN:
            raise ValueError(f"a vocabulary of {tok.tokenizer.get_vocab_size()} ids holds the reserved ones from {TURN} on")
        last, part, start = ..., 0, 0
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            if not roles:
                continue
            flat, sizes = tok.encode([x for r, t in zip(roles, texts, strict=True) for x in (escape_role(r), escape(t))])
            role, text = sizes[::2], sizes[1::2]
            ends = np.cumsum(role + text + 3)
            begins = ends - (role + text + 3)
            ids = np.empty(ends[-1], np.uint32)
            own = np.ones(len(ids), bool)
            for at, mark in ((begins, TURN), (begins + 1 + role, ROLE_END), (ends - 1, TURN_END)):
                ids[at], own[at] = mark, False
            ids[own] = flat
            said = np.array([r == "assistant" for r in roles])
            edges = np.zeros(len(ids) + 1, np.int8)
            edges[(begins + 2 + role)[said]] += 1
            edges[(ends - 1)[said]] -= 1
            mask = np.cumsum(edges[:-1], dtype=np.int8).astype(np.uint8)
            keys = batch.column("conv_id").to_pylist()
            fresh = np.array([True] + [x != y for x, y in zip(keys[1:], keys, strict=False)])
            conv = begins[np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))]
            piece = (begins - conv) // PART
            cut = np.flatnonzero(fresh | np.concatenate([[True], piece[1:] != piece[:-1]])).tolist()
            rows = []
            for i, j in zip(cut, [*cut[1:], len(keys)], strict=True):
                if last is ... or keys[i] != last:
                    last, part, start = keys[i], 0, 0
                a, b = int(begins[i]), int(ends[j - 1])
                rows.append((last, part, start, j - i, ids[a:b].astype("<u4").tobytes(), mask[a:b].tobytes(), task))
                part, start = part + 1, start + b - a
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*[x.split()[0] for x in PARTS.split(", ")], "task"])

    return run


def chat_format(turns: DataFrame, path: str) -> DataFrame:
    """PARTS rows of every conversation: ids, loss_mask (a byte for each id) and where in the conversation they start.

    Rows of a conversation are ordered by turn, then role, then text, nulls first. Null roles and texts count as empty; a
    null conv_id is a conversation too; repeated rows are turns of their own. No rows, no parts. A text of any length is
    one turn of one part. Other columns aren't read, whatever their names."""
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    parts = stored(ordered.mapInArrow(_formatted(path), PARTS + ", task int"))
    sizes = parts.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("loss_mask")).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    later = sizes.select("conv_id", "task", F.sum("n").over(earlier).alias("n"), F.sum("size").over(earlier).alias("size")).where("n > 0")
    # the first conversation of a task alone can go on from the task before: a row for each task
    later = F.broadcast(later.select(F.col("conv_id").alias("k"), F.col("task").alias("t"), "n", "size"))
    own = parts.join(later, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("task") == F.col("t")), "left")
    shift = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    return own.select("conv_id", shift("part", "n"), shift("start", "size"), "turns", "ids", "loss_mask")


def _turns_back(path: str):
    def run(batches):
        import pyarrow as pa

        words = _decoder(path)
        text = lambda xs: b"".join(map(words.__getitem__, xs)).decode("utf-8")
        key, state = ..., None

        def row():
            n, sha, chars, loss, formatted = state
            return [key, n, sha.hexdigest(), chars, loss.hexdigest(), formatted]

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list = []
        for batch in batches:
            for conv, raw, under in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_mask")], strict=True):
                if key is ... or conv != key:
                    if key is not ...:
                        out.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.frombuffer(raw, "<u4"), np.frombuffer(under, bool)
                begin, mid, end = (np.flatnonzero(ids == x).tolist() for x in (TURN, ROLE_END, TURN_END))
                for a, b, c in zip(begin, mid, end, strict=True):
                    role, said = unescape(text(ids[a + 1 : b].tolist())), text(ids[b + 1 : c].tolist())
                    state[0] += 1
                    state[1].update(f"{role}\n{unescape(said)}\n".encode())
                    if mask[b + 1 : c].any():
                        loss = unescape(text(ids[b + 1 : c][mask[b + 1 : c]].tolist()))
                        state[2] += len(loss)
                        state[3].update(loss.encode())
                state[4] += len(text(ids.tolist()))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)
                out = []
        if key is not ...:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    return run


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(parts: DataFrame, path: str) -> DataFrame:
    """Digests of each conversation, decoded from its ids and mask alone."""
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_turns_back(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_tokens(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one with control strings in its texts, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    path = vocabulary("byte_bpe_50k.json")
    return read_back(chat_format(rows.unionByName(extra), path), path)
