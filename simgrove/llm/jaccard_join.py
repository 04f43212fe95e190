"""Operator 9: near duplicates by the Jaccard similarity of word 5-grams, with Bayesian pruning of candidates.

1. Equal texts form one class and are compared once. A class's shingle set gives HASHES MinHash values, kept as BANDS
   band hashes: at a similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8^ROWS)^BANDS = 1 - 3e-6.
2. Classes that share a band are tied to the band's least class, which gives a row for each member and not for each
   pair, and the candidate groups are the connected components of these ties.
3. Ties of unlike texts can chain groups together without end. So in groups beyond SURE classes the members of each
   band meet with their MinHash values alone, in blocks, and only ties that the pruning below leaves hold: the group
   falls into the components of those, and classes without one leave it. Shingles move only after that.
4. Inside a group, MinHash values are compared a stretch at a time; a pair is dropped as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold is below TOLERANCE. The rest is verified
   exactly on the whole shingle sets.
5. Groups are cut into blocks; each pair of blocks is a task of its own with bounded memory. A task returns a class's
   number of links and a spanning forest of the links, never the pairs.
6. The links' connected components are the classes of near duplicates.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simgrove.llm.common import bounded_batches, distinct, hashed_words, kept, mix64, slices, small, stored, text_bytes, with_few

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STRETCH, TOLERANCE = 32, 1e-7
#: Classes in a block: LEAST_BLOCK while a group has at most SPREAD blocks, then up to BLOCK; and shingles in a block.
LEAST_BLOCK, SPREAD, BLOCK, BLOCK_SHINGLES = 64, 32, 256, 1_000_000
#: Groups of more classes are cut anew by their pruned ties, in blocks of so many classes.
SURE, TIE_BLOCK = 4096, 1024
#: Bytes of text that are hashed at a time.
HELD = 4_000_000

_seed = np.arange(1, 2 * HASHES + 1, dtype=np.uint64)
_MUL = (mix64(_seed[:HASHES] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (mix64(_seed[HASHES:] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of texts' word 5-grams, with repeats, and each text's number of them."""
    h, n = hashed_words(raw, at)
    if not len(h):
        return h, n
    begin = np.cumsum(n) - n
    k = np.minimum(n, SHINGLE)
    own = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(h)) <= (begin + n - k)[own]
    s = h.copy()
    for d in range(1, SHINGLE):
        longer = slice(0, max(0, len(h) - d))
        step = mix64(s[longer])
        step += h[d:]
        s[longer] = np.where((k > d)[own[longer]], step, s[longer])
    return mix64(s[first]), np.where(n > 0, n - k + 1, 0)


def shingles(texts: list[str] | str | None) -> list[np.ndarray] | np.ndarray:
    """The sorted distinct 64-bit hashes of each text's word 5-grams; a text of fewer words is one shingle, one without
    words has none. Words are runs without white space, with A-Z lower-cased."""
    if texts is None or isinstance(texts, str):
        return shingles([texts or ""])[0]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
    return _sets(np.frombuffer(b"".join(raw), np.uint8), at)


def _sets(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    s, n = _grams(raw, at)
    ends = np.cumsum(n)
    return [distinct(s[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each (non-empty) set."""
    return _signatures(np.concatenate(sets), np.array([len(s) for s in sets]))


def _signatures(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same of sets that lie one after the other; sets are hashed together, in stretches that fit a cache."""
    out = np.empty((len(n), HASHES), np.uint32)
    ends = np.concatenate([[0], np.cumsum(n)])
    for first, last in slices(ends, 60_000):
        x = (s[ends[first] : ends[last]] >> np.uint64(16)).astype(np.uint32)
        starts = ends[first:last] - ends[first]
        y = np.empty_like(x)
        for k in range(HASHES):
            np.bitwise_xor(x, _XOR[k], out=y)
            np.multiply(y, _MUL[k], out=y)
            out[first:last, k] = np.minimum.reduceat(y, starts)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    out = {}
    for n in range(STRETCH, HASHES + 1, STRETCH):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


_LEAST = least_matches()


def survivors(a: np.ndarray, b: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b) that no stretch drops; upper: only pairs with the first row below the second."""
    matches = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STRETCH):
        matches += a[:, None, k] == b[None, :, k]
    alive = matches >= _LEAST[STRETCH]
    if upper:
        alive &= np.tri(len(a), len(b), -1, dtype=bool).T
    i, j = np.nonzero(alive)
    m = matches[i, j].astype(np.int64)
    for n in range(STRETCH, HASHES, STRETCH):
        step = max(1, 2_000_000 // STRETCH)
        for s in range(0, len(i), step):
            at = slice(s, s + step)
            m[at] += (a[i[at], n : n + STRETCH] == b[j[at], n : n + STRETCH]).sum(1)
        keep = m >= _LEAST[n + STRETCH]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def _common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets i of a with sets j of b."""
    if len(i) < 2 * (len(a) + len(b)):
        return np.fromiter((len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)), np.int64, len(i))
    size = np.array([len(s) for s in a] + [len(s) for s in b])
    every = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(size)), size)
    _, col, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n > 1  # the others are in no intersection
    number = np.cumsum(shared) - 1
    take = shared[col]
    row, col = row[take], number[col[take]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(size), 4096), np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return np.rint(out[i, j]).astype(np.int64)


def links(a_sets, b_sets, a_sig, b_sig, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a similarity of THRESHOLD or more."""
    i, j = survivors(a_sig, b_sig, upper)
    if not len(i):
        return i, j
    n = _common(a_sets, b_sets, i, j)
    total = np.array([len(s) for s in a_sets])[i] + np.array([len(s) for s in b_sets])[j] - n
    keep = n >= THRESHOLD * total - 1e-9
    return i[keep], j[keep]


def _signed(batches):
    import pyarrow as pa

    kept.free()
    for batch in batches:
        raw, at = text_bytes(batch.column("text"))
        for first, last in slices(at, HELD):
            s, n = _grams(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            full = np.flatnonzero(n)
            sig = _signatures(s, n[full]) if len(full) else np.empty((0, HASHES), np.uint32)
            rows = last - first
            has = np.zeros(rows, bool)
            has[full] = True
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]) * BANDS, pa.int32()), pa.array(band_hashes(sig).reshape(-1)), mask=pa.array(~has))
            values: list = [None] * rows
            for k, row in zip(full.tolist(), sig, strict=True):
                values[k] = row.tobytes()
            part = batch.slice(first, rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n, pa.int64()), bands, pa.array(values, pa.binary())], ["doc_id", "th", "size", "bands", "sig"])


def _hashed(batches):
    import pyarrow as pa

    keep = ("node", "copies", "comp", "block", "blocks")
    kept.free()
    for batch in batches:
        raw, at = text_bytes(batch.column("text"))
        for first, last in slices(at, HELD):
            part = batch.slice(first, last - first)
            sets = _sets(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array([s.tobytes() for s in sets], pa.binary())], [*keep, "hashes"])


def _forest(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each node's place is linked to."""
    root = np.arange(len(node))
    while len(i):  # least label along the links, until nothing changes
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _sides(table):
    """Distinct nodes' rows of a pair of blocks, and the places of the two blocks' rows (the same ones for one block)."""
    import pyarrow as pa

    _, first = np.unique(table.column("node").to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    block = table.column("block").to_numpy()
    return table, np.flatnonzero(block == left), np.flatnonzero(block == right), left == right


def _tied(table):
    """One pair of blocks of a band: a forest (node, root) of the ties that the pruning leaves."""
    import pyarrow as pa

    table, p, q, one = _sides(table)
    node = table.column("node").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), HASHES)
    i, j = survivors(sig[p], sig[q], one)
    root = node[_forest(node, p[i], q[j])]
    return pa.table({"node": node, "root": root}).filter(pa.array(root != node))


def _compare(table):
    """One pair of blocks: rows (node, links, root): links found here, counted in documents, and an edge of their forest."""
    import pyarrow as pa

    table, p, q, one = _sides(table)
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    sig = signatures(sets)
    i, j = links([sets[x] for x in p], [sets[x] for x in q], sig[p], sig[q], one)
    i, j = p[i], q[j]
    count = np.zeros(len(node), np.int64)
    np.add.at(count, i, copies[j])
    np.add.at(count, j, copies[i])
    return pa.table({"node": node, "links": count, "root": node[_forest(node, i, j)]}).filter(pa.array(count > 0))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of the edges (a, b) is connected to.

    Labels are the least of the neighbours' and then of the label's own label, so chains shrink by halves; every round
    is a table in the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        step = labels.join(near, "node").select("node", F.least("comp", "low").alias("new"), F.col("comp").alias("old"))
        hop = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        fresh = stored(step.join(hop, "new").select("node", F.least("new", "far").alias("comp"), "old"))
        if fresh.where("comp <> old").limit(1).count() == 0:
            return fresh.select("node", "comp")
        labels = fresh.select("node", "comp")


def _dealt(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows of (key, node, blocks) with `block`, once for each other block of their key, as `left` and `right`."""
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    df = df.withColumn("other", other)
    return df.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))


def _block(blocks: str):
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _thinned(ties: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of ties (node, low): of a node's up to BANDS ties or more the least stays; it is
    tied to the others' ends, of which a group has few."""
    ties = stored(ties.withColumn("a", F.min("low").over(Window.partitionBy("node"))))
    ends = ties.select("a", F.col("low").alias("b")).where("a <> b").distinct()
    return ties.select("a", F.col("node").alias("b")).distinct().union(ends)


def _cut_anew(groups: DataFrame, banded: DataFrame, same: DataFrame) -> DataFrame:
    """(node, comp) with the groups beyond SURE cut by their pruned ties."""
    wide = stored(groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SURE).select("comp"))
    if not wide.limit(1).count():
        return groups
    marked = stored(with_few(groups, wide.withColumn("wide", F.lit(True)), "comp", "left"))
    inside = marked.where("wide").select("node")
    met = stored(banded.join(inside, "node", "left_semi"))
    # bands with the same members are compared once
    sets = met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    sets = sets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / TIE_BLOCK).cast("int").alias("blocks"))
    dealt = _dealt(with_few(met, sets, "band").withColumn("block", _block("blocks")), "band", "blocks").select("band", "left", "right", "block", "node")
    ties = dealt.join(same.select("node", "sig"), "node").groupBy("band", "left", "right").applyInArrow(_tied, "node long, root long")
    fresh = components(_thinned(ties.select("node", F.col("root").alias("low")).distinct()))
    return stored(marked.where("wide is null").select("node", "comp").union(fresh.select("node", "comp")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, th (hash of its text), class_id (the least doc_id of its class) and n_links
    (other documents with a similarity of 0.8 or more, copies included).

    Texts without words, null ones too, are similar to nothing but equal texts; each null text is a class of its own
    with a null th. Repeated rows are copies; where documents tie for a class's least id, that id is the class's. The
    class_id of documents without an id alone is null. No rows, no classes. A very long text is one shingle set in the
    memory of its tasks. Other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.md5(F.col(text)).alias("th"))
    signed = rows.where("th is not null").mapInArrow(_signed, "doc_id long, th string, size long, bands array<long>, sig binary")
    same = stored(signed.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))
    banded = same.where("bands is not null").select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "low")
    groups = _cut_anew(components(_thinned(banded.join(shared, "band").where("node <> low").select("node", "low").distinct())), banded, same)
    slim = same.select("node", "th", "rep", "copies", "size")
    sized = stored(groups.join(slim, "node"))
    n, least, most = F.count(F.lit(1)), F.ceil(F.sum("size") / BLOCK_SHINGLES), lambda size: F.ceil(F.count(F.lit(1)) / size)
    blocks = F.greatest(F.least(most(LEAST_BLOCK), F.lit(SPREAD)), most(BLOCK), least).cast("int")
    cut = sized.groupBy("comp").agg(n.alias("n"), blocks.alias("blocks")).where("blocks > 1").select("comp", "blocks")
    sized = with_few(sized, cut, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = stored(sized.withColumn("block", _block("blocks")).select("node", "th", "rep", "copies", "comp", "block", "blocks"))
    keys = small(members.select("th", F.col("rep").alias("doc_id")))
    texts = rows.join(keys, (rows["th"] == keys["th"]) & rows["doc_id"].eqNullSafe(keys["doc_id"]), "left_semi").dropDuplicates(["th"])
    hashed = texts.join(members.drop("rep"), "th").select("node", "copies", "comp", "block", "blocks", "text").mapInArrow(_hashed, "node long, copies long, comp long, block int, blocks int, hashes binary")
    dealt = _dealt(hashed, "comp", "blocks").drop("other")
    found = stored(dealt.groupBy("comp", "left", "right").applyInArrow(_compare, "node long, links long, root long"))
    classes = components(_thinned(found.where("node <> root").select("node", F.col("root").alias("low")).distinct()))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = stored(slim.join(classes, "node").join(counted, "node").select("node", "comp", "rep", "links"))
    least = linked.groupBy("comp").agg(F.min("rep").alias("class_id"))
    linked = with_few(linked, least, "comp").select("node", "class_id", "links")
    named = stored(slim.join(linked, "node", "left").select("th", F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    out = rows.select("doc_id", "th").join(named, "th", "left")
    return out.select("doc_id", "th", F.when(F.col("th").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The frame's rows, all columns, with one document of each class: that of the least id. Null texts all stay. Of
    rows that share that id and text, one stays. Columns of any name pass through."""
    found = near_duplicates(docs, key, text)
    # the least id stands for its class; several rows may share it, and a class without ids keeps its least text
    reps = found.where("th is not null").groupBy("class_id").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.struct("doc_id", "th"))).alias("k")).select("k.*")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("id"), F.md5(F.col(text)).alias("th"))
    reps = small(stored(reps.select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th"))))
    kept = row.join(reps, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")), "left_semi").dropDuplicates(["id", "th"])
    return kept.unionByName(row.where("th is null")).select("row.*")


def op9_bayesian_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document's class and number of links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
