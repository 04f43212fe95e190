"""Operator 7: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

Counting. Words are 64-bit hashes. Tasks count a bounded stretch of text at a time with array sorts and deal the counts
to buckets. A bigram's key is a prefix of its context's hash and then bits of both words, so a context's bigrams meet
in one bucket; contexts with more than a bucket's fair share of all tokens (fewer than there are buckets, known from
the exact unigram counts) are dealt by both words instead, so no bucket grows with a frequent word. The number of
buckets follows the tokens counted. Each bucket is merged apart and written as two files in the shared folder: sorted
keys and their counts. A second, smaller shuffle brings each word's count, the number of its left neighbours and the
figures of its followers together, again as sorted arrays.

Scoring. Workers memory-map a bucket's arrays for as long as they look it up (a folder that can't be mapped is read
bucket by bucket); lookups of a stretch of text are sorted first, so they walk each file once. Only a manifest of the
files and a few totals go through the driver.

P(w|h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) P1(w), and P1 likewise from the numbers of left neighbours, backed by
1 / (V + 1). Order 2, for the disk: in 0.51 GB of documents 136 million tokens make 48 million distinct bigrams and 89
million trigrams. Trigrams counted by stretches of 2.5 million tokens are 116 million rows, at three words each 3.3 times
the input to shuffle and 1.8 times to keep, on top of the bigrams' 3 times; the limit is 4.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.llm.common import bounded_batches, distinct, hashed_words, kept, map_array, mix64, put_file, shared_dir, slices, stored, text_bytes, text_of

#: Hashes of the end of a text and of the place before its first word.
END, BEGIN = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: Bytes of text that a task counts or scores at a time (a longer text alone), and tokens that fill a bucket.
HELD, BUCKET = 12_000_000, 1 << 21
#: Bits of a key that name its place among the buckets.
PREFIX = 20
MODULUS, HELD_OUT = 7, 2
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bigram_keys(h: np.ndarray, w: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """PREFIX bits of the context (of both words for heavy contexts), then bits of both words."""
    rest = np.uint64(64 - PREFIX)
    own = mix64(h)
    both = w * _GOLD
    both += own
    both = mix64(both)
    own >>= rest
    if len(heavy):
        at = np.searchsorted(heavy, h)
        np.minimum(at, len(heavy) - 1, out=at)
        hot = heavy[at] == h
        own[hot] = mix64(both[hot]) >> rest
    own <<= rest
    both &= np.uint64((1 << (64 - PREFIX)) - 1)
    both |= own
    return both


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, an index of each in the input, and counts or sums of weights (rows)."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    if weights is None:
        sums = np.diff(np.append(first, len(keys)))
    else:
        sums = np.add.reduceat(weights[order], first, axis=0) if len(keys) else weights[:0]
    return ordered[first], order[first], sums


def _stretches(batches):
    """Bounded stretches of texts: their tokens and the texts' lengths, with the rows' first column."""
    kept.free()
    held, n = [], 0
    for batch in batches:
        raw, at = text_bytes(batch.column("text"))
        for first, last in slices(at, HELD):
            if held and n + at[last] - at[first] > HELD:
                yield _joined_up(held)
                held, n = [], 0
            words, sizes = hashed_words(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            held.append((batch.column(0)[first:last].to_pylist(), np.insert(words, np.cumsum(sizes), END), sizes + 1))
            n += at[last] - at[first]
    if held:
        yield _joined_up(held)


def _joined_up(held: list):
    return [x for h in held for x in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])


def _contexts(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.cumsum(sizes) - sizes] = BEGIN
    return h


def _by_bucket(buckets: np.ndarray, columns: dict[str, np.ndarray], kind: str):
    """Rows (kind, bucket, a, b, c, d) of arrays that are sorted by bucket."""
    import pyarrow as pa

    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(buckets))
    names = ["a", "b", "c", "d"]
    rows = [pa.array([kind] * len(edges)), pa.array(buckets[edges].astype(np.int32) if len(edges) else [], pa.int32())]
    for k in names:
        x = columns.get(k)
        rows.append(pa.nulls(len(edges), pa.binary()) if x is None else pa.array([x[s:e].tobytes() for s, e in zip(edges, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(rows, ["kind", "bucket", *names])


ROWS = "kind string, bucket int, a binary, b binary, c binary, d binary"


def _unigrams(bits: int):
    def run(batches):
        for _, w, _ in _stretches(batches):
            keys, _, counts = _counted(w)
            yield _by_bucket(keys >> np.uint64(64 - bits), {"a": keys, "b": counts.astype(np.uint64)}, "c")

    return run


def _joined(table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype)


def _merge_unigrams(table):
    import pyarrow as pa

    keys, _, counts = _counted(_joined(table, "a", np.uint64), _joined(table, "b", np.uint64))
    return pa.table({"kind": ["c"], "bucket": [table.column("bucket")[0].as_py()], "a": [keys.tobytes()], "b": [counts.tobytes()], "c": [b""], "d": [np.array([counts.sum()], np.uint64).tobytes()]}, schema=_schema())


def _frequent(least: int):
    """The words counted so often."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, counts in zip(*(batch.column(k).to_pylist() for k in "ab"), strict=True):
                yield pa.record_batch({"word": pa.array([np.frombuffer(keys, np.uint64)[np.frombuffer(counts, np.uint64) >= least].tobytes()], pa.binary())})

    return run


def _schema():
    import pyarrow as pa

    return pa.schema([("kind", pa.string()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in "abcd"]])


def _bigrams(bits: int, heavy: np.ndarray):
    def run(batches):
        for _, w, sizes in _stretches(batches):
            h = _contexts(w, sizes)
            keys, at, counts = _counted(bigram_keys(h, w, heavy))
            # contexts in runs, which say each context once
            rest = np.uint64(64 - PREFIX)
            order = np.argsort((keys >> rest << rest) | (mix64(h[at]) >> np.uint64(PREFIX)))
            keys, at, counts = keys[order], at[order], counts[order]
            own, bucket = h[at], keys >> np.uint64(64 - bits)
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]))
            runs = np.diff(np.append(first, len(own))).astype(np.uint32)
            heads = _by_bucket(bucket[first], {"a": own[first], "b": runs}, "b")
            tails = _by_bucket(bucket, {"c": w[at], "d": counts.astype(np.uint32)}, "b")
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([heads.column(0), heads.column(1), heads.column(2), heads.column(3), tails.column(4), tails.column(5)], heads.schema.names)

    return run


def _counts_of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def _merge_bigrams(word_bits: int, heavy: np.ndarray, folder: str):
    def run(table):
        import pyarrow as pa

        h = np.repeat(_joined(table, "a", np.uint64), _joined(table, "b", np.uint32))
        w, c = _joined(table, "c", np.uint64), _joined(table, "d", np.uint32).astype(np.int64)
        keys, at, c = _counted(bigram_keys(h, w, heavy), c)
        h, w = h[at], w[at]
        bucket = table.column("bucket")[0].as_py()
        files = [put_file(folder, f"bigram-{bucket:05d}-{n}", x.tobytes()) for n, x in (("keys", keys), ("counts", c.astype(np.uint32)))]
        out = [pa.RecordBatch.from_arrays([pa.array([x]) for x in ("m",)] + [pa.array([bucket], pa.int32())] + [pa.array([x], pa.binary()) for x in (files[0].encode(), files[1].encode(), np.array([len(keys), *_counts_of_counts(c)], np.int64).tobytes(), b"")], schema=_schema())]
        words, _, left = _counted(w)
        out.append(_by_bucket(words >> np.uint64(64 - word_bits), {"a": words, "b": left.astype(np.uint32)}, "w"))
        kinds = np.stack([c, c == 1, c == 2, c >= 3], 1).astype(np.int64)
        contexts, _, figures = _counted(h, kinds)
        out.append(_by_bucket(contexts >> np.uint64(64 - word_bits), {"a": contexts, "b": figures[:, 0].copy(), "c": figures[:, 1:].astype(np.uint32)}, "h"))
        return pa.Table.from_batches([x.cast(_schema()) for x in out])

    return run


#: Figures of a word: count, left neighbours, tokens after it, followers seen once, twice, more often.
FIGURES = np.dtype([("c", "<u8"), ("left", "<u4"), ("t", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def _merge_words(folder: str):
    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        part = {k: table.filter(pc.equal(table.column("kind"), k)) for k in ("c", "w", "h")}
        cut = {k: _joined(t, "a", np.uint64) for k, t in part.items()}
        keys = distinct(np.concatenate([*cut.values()]))
        x = np.zeros(len(keys), FIGURES)
        at = {k: np.searchsorted(keys, v) for k, v in cut.items()}
        c, left, t = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        np.add.at(c, at["c"], _joined(part["c"], "b", np.uint64).astype(np.int64))
        np.add.at(left, at["w"], _joined(part["w"], "b", np.uint32).astype(np.int64))
        np.add.at(t[:, 0], at["h"], _joined(part["h"], "b", np.int64))
        np.add.at(t[:, 1:], at["h"], _joined(part["h"], "c", np.uint32).reshape(-1, 3).astype(np.int64))
        for name, v in (("c", c), ("left", left), ("t", t[:, 0]), ("n1", t[:, 1]), ("n2", t[:, 2]), ("n3", t[:, 3])):
            x[name] = v
        bucket = table.column("bucket")[0].as_py()
        files = [put_file(folder, f"word-{bucket:05d}-{n}", v.tobytes()) for n, v in (("keys", keys), ("figures", x))]
        totals = [int(c.sum()), int((c > 0).sum()), int(left.sum()), *_counts_of_counts(left), int((left > 2).sum())]
        return pa.table({"kind": ["m"], "bucket": [bucket], "a": [files[0].encode()], "b": [files[1].encode()], "c": [np.array(totals, np.int64).tobytes()], "d": [b""]}, schema=_schema())

    return run


def discounts(n: list[int]) -> np.ndarray:
    """D(0..3) of modified Kneser-Ney from the numbers of things seen once to four times; where these are 0, which
    tiny texts can bring about, a discount of half the count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    d = [0.0] + [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k / 2 for k in (1, 2, 3)]
    return np.clip(np.array(d), 0, np.arange(4))


class Model:
    """What workers need: files by bucket, totals, discounts. Small; the arrays stay in their files."""

    def __init__(self, bits: int, word_bits: int, heavy: np.ndarray, bigrams: dict, words: dict, bigram_n: list[int], word_totals: list[int]):
        self.heavy, self.bigrams, self.words = heavy, (bits, bigrams), (word_bits, words)
        self.tokens, self.vocabulary, self.pairs = word_totals[:3]
        self.d2, self.d1 = discounts(bigram_n), discounts(word_totals[3:7])
        one, two, more = word_totals[3], word_totals[4], word_totals[7]
        self.back1 = float(self.d1 @ np.array([0, one, two, more])) / self.pairs if self.pairs else 1.0

    def _find(self, table: tuple[int, dict], queries: np.ndarray, dtype) -> np.ndarray:
        """The values of sorted queries, zero where the key is absent."""
        bits, files = table
        out = np.zeros(len(queries), dtype)
        edges = np.append(np.searchsorted(queries, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(queries))
        for b, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if s == e or b not in files:
                continue
            keys, values = (map_array(path, kind) for path, kind in zip(files[b], (np.uint64, dtype), strict=True))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, queries[s:e]), len(keys) - 1)
                hit = keys[at] == queries[s:e]
                out[s:e][hit] = values[at[hit]]
        return out

    def score(self, w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of texts."""
        h = _contexts(w, sizes)
        every = np.append(w, BEGIN)
        distinct, inverse = np.unique(every, return_inverse=True)
        x = self._find(self.words, distinct, FIGURES)
        own, before = inverse[:-1], np.empty(len(w), np.int64)
        before[1:] = own[:-1]
        before[np.cumsum(sizes) - sizes] = inverse[-1]
        c = x["c"][own].astype(float)
        base = np.log10((c + 1) / (self.tokens + self.vocabulary + 1))
        left = x["left"].astype(float)
        one = np.full(len(x), self.back1 / (self.vocabulary + 1))
        if self.pairs:
            one += np.maximum(left - self.d1[np.minimum(x["left"], 3)], 0) / self.pairs
        total = x["t"].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, (self.d2[1] * x["n1"] + self.d2[2] * x["n2"] + self.d2[3] * x["n3"]) / total, 1.0)
        keys = bigram_keys(h, w, self.heavy)
        order = np.argsort(keys)
        pair = np.empty(len(w), np.int64)
        pair[order] = self._find(self.bigrams, keys[order], np.dtype(np.uint32))
        p = back[before] * one[own]
        seen = pair > 0
        p[seen] += np.maximum(pair[seen] - self.d2[np.minimum(pair[seen], 3)], 0) / total[before[seen]]
        first = np.cumsum(sizes) - sizes
        return np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


def train(docs: DataFrame) -> Model:
    """The model of the texts of a frame (first column, text). Null texts count as empty: an end alone. No texts: every
    word gets 1 / (V + 1) = 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    first_bits = min(14, max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    folder = f"{shared_dir(spark)}.kn"
    own = stored(docs.mapInArrow(_unigrams(first_bits), ROWS).groupBy("bucket").applyInArrow(_merge_unigrams, ROWS))
    n = sum(int(np.frombuffer(r["d"], np.uint64)[0]) for r in own.select("d").collect())  # a number for each bucket
    bits = min(PREFIX, max(4, (n // BUCKET).bit_length()))
    word_bits = min(bits, first_bits)
    often = own.select("a", "b").mapInArrow(_frequent((n >> bits) + 1), "word binary").collect()  # fewer words than buckets
    heavy = np.union1d(np.frombuffer(b"".join(r["word"] for r in often), np.uint64), np.array([BEGIN], np.uint64))
    merged = stored(docs.mapInArrow(_bigrams(bits, heavy), ROWS).groupBy("bucket").applyInArrow(_merge_bigrams(word_bits, heavy, folder), ROWS))
    own = own.select("kind", F.shiftright("bucket", first_bits - word_bits).alias("bucket"), "a", "b", F.lit(None).cast("binary").alias("c"), F.lit(None).cast("binary").alias("d"))
    words = stored(own.unionByName(merged.where("kind <> 'm'")).groupBy("bucket").applyInArrow(_merge_words(folder), ROWS)).collect()
    pairs = merged.where("kind = 'm'").collect()  # a row for each bucket
    total = lambda rows, k: np.sum([np.frombuffer(r["c"], np.int64) for r in rows] or [np.zeros(k, np.int64)], axis=0).tolist()
    files = lambda rows: {r["bucket"]: (bytes(r["a"]).decode(), bytes(r["b"]).decode()) for r in rows}
    return Model(bits, word_bits, heavy, files(pairs), files(words), total(pairs, 5)[1:], total(words, 8))


def _scored(model: Model):
    def run(batches):
        import pyarrow as pa

        for ids, w, sizes in _stretches(batches):
            known, base, score = model.score(w, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of (doc_id, text)."""
    return docs.mapInArrow(_scored(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and score. A null doc_id's text is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rest = lambda c: F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "utf-8")) % MODULUS
    model = train(docs.where(rest(F.col("doc_id")) != HELD_OUT))
    out = score(docs, model)
    return out.select("doc_id", (rest(F.col("doc_id")) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
