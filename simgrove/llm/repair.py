"""Operator 1: token ids in Re-Pair compressed blocks that decode from any place.

Documents are encoded in ascending doc_id order; a shard is a range of doc_id and a row of files in blocks of about
BLOCK_IDS ids, each with a grammar of its own, so that memory is bounded and a block decodes alone. Rounds of Re-Pair
replace frequent adjacent pairs by nonterminals, the most frequent ones first, until no pair repays its rule; pairs
don't cross documents. A round replaces all pairs of its class of frequency, which keeps it a few array passes, and later
rounds look only beside the symbols that the last one made. Rules are stored with the lengths they expand to, so a
place in a document is found by sums of lengths, and only the symbols there are expanded.

The file format is a Parquet table of blocks (columns in BLOCK_SCHEMA, numbers little-endian), written by Spark: its
commit keeps blocks of lost or repeated attempts out. A block knows where it starts in its shard, and the sums of the
shards (a row each) give where a shard starts among all documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simgrove.llm.common import bounded_batches, ragged, shared_dir, slices, text_bytes, text_of, trim
from simgrove.llm.tokens import GROUP_BYTES, encoder, vocabulary

END = 2
BLOCK_IDS = 1_500_000
#: Nonterminals count from here on.
FIRST_RULE = 1 << 20
#: A rule takes three numbers (its pair and its length), so that a pair repays it from so many uses on.
LEAST_USES = 4
#: Uses that a pair needs in the first rounds; then LEAST_USES.
CLASSES = (64, 16)
BLOCK_SCHEMA = "shard int, start long, n_tokens long, first_id long, last_id long, doc_ids array<bigint>, doc_tokens binary, doc_symbols binary, rules binary, rounds binary, lengths binary, symbols binary"


def _frequent(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur so often, sorted, and how often."""
    ordered = np.sort(code)
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    count = np.diff(np.append(edge, len(ordered)))
    often = count >= least
    return ordered[edge[often]], count[often]


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places at (ascending) to replace: of two in a row, which overlap, the pair of the higher rank, and
    of one pair's own every second one."""
    best, open_ = np.zeros(len(at), bool), np.ones(len(at), bool)
    for _ in range(3):
        k = np.flatnonzero(open_)
        if not len(k):
            break
        near = np.diff(at[k]) == 1
        left, right = np.concatenate([[False], near]), np.concatenate([near, [False]])
        own = rank[k]
        wins = (~left | (own > np.concatenate([own[:1], own[:-1]]))) & (~right | (own > np.concatenate([own[1:], own[-1:]])))
        best[k[wins]] = True
        gone = wins.copy()
        gone[1:] |= near & wins[:-1]
        gone[:-1] |= near & wins[1:]
        open_[k[gone]] = False
    k = np.flatnonzero(open_)
    if len(k):
        first = np.concatenate([[True], np.diff(at[k]) != 1])
        best[k] = (np.arange(len(k)) - np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))) % 2 == 0
    return best


def compress(ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """ids of documents (of the given sizes, one after the other) -> rules, their rounds' ends, lengths, symbols and
    each document's number of symbols. In the end no pair occurs LEAST_USES times apart."""
    s = ids.astype(np.int64)
    starts = np.zeros(len(s) + 1, bool)
    starts[np.concatenate([[0], np.cumsum(sizes)])] = True
    rules, rounds, n_rules = [np.empty((0, 2), np.int64)], [], 0
    lengths = np.empty(0, np.int64)
    step, look = 0, None  # look: where pairs may have become frequent; None: everywhere
    while len(s) > 1:
        least = CLASSES[step] if step < len(CLASSES) else LEAST_USES
        if look is None:
            look = np.flatnonzero(~starts[1 : len(s)])
        code = (s[look] << 32) | s[look + 1]
        pairs, count = _frequent(code, least)
        at = which = np.empty(0, np.int64)
        if len(pairs):
            # a table by 20 bits of a code's hash names its pair; pairs that lost their place in it are searched for
            spread = lambda c: ((c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            place, table = spread(pairs), np.full(1 << 20, -1, np.int32)
            table[place] = np.arange(len(pairs))
            named = table[spread(code)]
            maybe = np.flatnonzero(named >= 0)
            which, own = named[maybe].astype(np.int64), code[maybe]
            hit = pairs[which] == own
            if (table[place] != np.arange(len(pairs))).any():
                lost = np.flatnonzero(~hit)
                k = np.minimum(np.searchsorted(pairs, own[lost]), len(pairs) - 1)
                which[lost], hit[lost] = k, pairs[k] == own[lost]
            at, which = look[maybe[hit]], which[hit]
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((pairs, count))] = np.arange(len(pairs))
            taken = _apart(at, rank[which])
            uses = np.bincount(which[taken], minlength=len(pairs))
            taken &= uses[which] >= LEAST_USES
            if not taken.any():  # pairs stand in each other's way: the most frequent one alone
                for one in np.argsort(-count, kind="stable").tolist():
                    own = which == one
                    alone = _apart(at[own], np.ones(own.sum()))
                    if alone.sum() >= LEAST_USES:
                        taken[np.flatnonzero(own)[alone]] = True
                        break
            at, which = at[taken], which[taken]
        step += 1
        if not len(at):
            if step > len(CLASSES) and len(look) == (~starts[1 : len(s)]).sum():
                break
            look = None  # the pairs beside new symbols are done: look everywhere, in the end once more
            continue
        used = np.flatnonzero(np.bincount(which, minlength=len(pairs)))
        number = np.empty(len(pairs), np.int64)
        number[used] = np.arange(len(used))
        new = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1)
        lengths = np.concatenate([lengths, _lengths_of(new, lengths).sum(1)])
        s[at] = FIRST_RULE + n_rules + number[which]
        rules.append(new)
        n_rules += len(new)
        rounds.append(n_rules)
        stay = np.ones(len(s) + 1, bool)
        stay[at + 1] = False
        at -= np.arange(len(at))  # where the new symbols lie when their second places are gone
        s, starts = s[stay[:-1]], starts[stay]
        look = None
        if step > len(CLASSES):
            near = np.zeros(len(s) + 1, bool)
            near[at] = near[np.maximum(at - 1, 0)] = True
            near[:-1] &= ~starts[1 : len(s) + 1]
            look = np.flatnonzero(near[: len(s) - 1])
    # documents without ids share a start: count symbols by the ids they expand to
    expanded = np.concatenate([[0], np.cumsum(_lengths_of(s, lengths))])
    bounds = np.searchsorted(expanded, np.concatenate([[0], np.cumsum(sizes)]))
    return {"rules": np.concatenate(rules).astype("<u4"), "rounds": np.array(rounds, "<u4"), "lengths": lengths.astype("<u4"), "symbols": s.astype("<u4"), "doc_symbols": np.diff(bounds).astype("<u4")}


def _lengths_of(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(1, np.int64), lengths.astype(np.int64)])[np.maximum(symbols.astype(np.int64) - FIRST_RULE + 1, 0)]


def expand(symbols: np.ndarray, rules: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """The ids of a stretch of symbols: rounds are undone from the last."""
    s, rules = symbols.astype(np.int64), rules.reshape(-1, 2).astype(np.int64)
    for low in reversed([0, *rounds[:-1].tolist()] if len(rounds) else []):
        at = np.flatnonzero(s >= FIRST_RULE + low)
        twice = np.ones(len(s), np.int64)
        twice[at] = 2
        place = np.cumsum(twice) - twice
        out = np.empty(len(s) + len(at), np.int64)
        out[place] = s
        out[place[at]] = rules[s[at] - FIRST_RULE, 0]
        out[place[at] + 1] = rules[s[at] - FIRST_RULE, 1]
        s = out
    return s.astype("<u4")


def expand_all(symbols: np.ndarray, rules: np.ndarray, rounds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of a whole block: each rule is expanded once, round by round, and then each symbol is looked up."""
    rules, sizes = rules.reshape(-1, 2).astype(np.int64), lengths.astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), "<u4")

    def of(s):
        known = s >= FIRST_RULE
        rule = np.where(known, s - FIRST_RULE, 0)
        size = np.where(known, sizes[rule], 1) if len(sizes) else np.ones(len(s), np.int64)
        at = ragged(np.where(known, begins[rule], 0) if len(sizes) else np.zeros(len(s), np.int64), size)
        out = flat[at] if len(flat) else np.empty(len(at), "<u4")
        place = np.cumsum(size) - size
        out[place[~known]] = s[~known]
        return out

    for low, high in zip([0, *rounds[:-1].tolist()], rounds.tolist(), strict=True) if len(rounds) else ():
        flat[begins[low] : begins[high - 1] + sizes[high - 1]] = of(rules[low:high].reshape(-1))
    return of(symbols.astype(np.int64))


class Block:
    """A row of the block table."""

    def __init__(self, row):
        get = lambda k: np.frombuffer(row[k], "<u4")
        self.rules, self.rounds, self.lengths, self.symbols, self.doc_symbols, self.doc_tokens = map(get, ("rules", "rounds", "lengths", "symbols", "doc_symbols", "doc_tokens"))
        self.first = np.concatenate([[0], np.cumsum(self.doc_symbols.astype(np.int64))])

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids start to stop of the block's doc-th document; only the symbols that hold them are expanded."""
        own = self.symbols[self.first[doc] : self.first[doc + 1]]
        stop = int(self.doc_tokens[doc]) if stop is None else min(stop, int(self.doc_tokens[doc]))
        ends = np.cumsum(_lengths_of(own, self.lengths))
        a, b = np.searchsorted(ends, [start, stop - 1], side="right") if stop > start else (0, -1)
        before = int(ends[a - 1]) if a else 0
        return expand(own[a : b + 1], self.rules, self.rounds)[start - before : max(start, stop) - before]


def _write(path: str, end: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, start = TaskContext.get().partitionId(), 0
        held: list = []
        n = 0

        def block():
            nonlocal held, n, start
            ids, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            doc_ids = [d for h in held for d in h[0]]
            c = compress(ids, sizes)
            known = [d for d in doc_ids if d is not None]
            row = {"shard": shard, "start": start, "n_tokens": len(ids), "first_id": known[0] if known else None, "last_id": known[-1] if known else None, "doc_ids": doc_ids, "doc_tokens": sizes.astype("<u4").tobytes(), **{k: v.tobytes() for k, v in c.items()}}
            start, held, n = start + len(ids), [], 0
            kinds = {"shard": pa.int32(), "start": pa.int64(), "n_tokens": pa.int64(), "first_id": pa.int64(), "last_id": pa.int64(), "doc_ids": pa.list_(pa.int64())}
            names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([row[k]], kinds.get(k, pa.binary())) for k in names], names)

        tok = encoder(path)
        for batch in batches:
            (raw, at), docs = text_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in slices(at, GROUP_BYTES):
                ids, sizes = tok.encode_bytes(raw[at[a] : at[b]], at[a : b + 1] - at[a], end)
                held.append((docs[a:b], ids, sizes))
                n += len(ids)
                if n >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()
        trim()

    return run


def write_ids(docs: DataFrame, folder: str, path: str, shards: int | None = None, end: int = END) -> str:
    """Write the ids of (doc_id, text) rows to a folder, in ascending doc_id order (nulls first). Null texts count as
    empty; repeated rows are written each; no rows, no blocks."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # a third key, so that even a row that repeats without end is dealt to several shards
    rows = rows.withColumn("_t", F.xxhash64("text")).withColumn("_r", F.monotonically_increasing_id())
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, "doc_id", "_t", "_r").sortWithinPartitions("doc_id", "_t", "_r")
    sorted_rows.select("doc_id", "text").mapInArrow(_write(path, end), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(folder)
    return folder


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row)
            ids = expand_all(b.symbols, b.rules, b.rounds, b.lengths)
            size = b.doc_tokens.astype(np.int64)
            begin = np.cumsum(size) - size
            raw = ids.astype("<u4", copy=False).tobytes()
            first = 0
            while first < len(size):  # a bounded stretch of documents in a batch
                last = max(first + 1, int(np.searchsorted(begin, begin[first] + 500_000)))
                cols = [pa.array(row["doc_ids"][first:last], pa.int64()), pa.array([row["shard"]] * (last - first), pa.int32()), pa.array(row["start"] + begin[first:last]), pa.array(size[first:last]), pa.array([raw[4 * x : 4 * (x + n)] for x, n in zip(begin[first:last].tolist(), size[first:last].tolist(), strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "shard", "start", "n_tokens", "ids"])
                first = last


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of a folder's documents."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.broadcast(sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin")))  # a row for each shard
    docs = blocks.mapInArrow(_read, "doc_id long, shard int, start long, n_tokens long, ids binary")
    return docs.join(begins, "shard").select("doc_id", (F.col("start") + F.col("_begin")).alias("start"), "n_tokens", "ids")


def fetch(spark: SparkSession, folder: str, doc_id: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """ids (binary) start to stop of the documents with this id, a row for each. Only blocks whose range of ids holds it
    are read, and of those only the symbols of the stretch are expanded."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                found = [block.ids(k, start, stop).tobytes() for k, d in enumerate(row["doc_ids"]) if d == doc_id]
                yield pa.record_batch({"ids": pa.array(found, pa.binary())})

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return blocks.mapInArrow(run, "ids binary")


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the files read back."""
    folder = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark) + ".blocks", vocabulary("word_bpe_49k.json"))
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
