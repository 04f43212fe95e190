"""Operator 8 [native]: benchmark decontamination by winnowing.

Words are hashed, runs of K words hashed again, and of each window of W such runs the least hash is kept (the last of
equals). A span of W + K - 1 = 10 equal words fills such a window on both sides, whatever stands around it, so both
sides keep the same fingerprint: no shared span of 10 words is missed. Fingerprints of documents and benchmark are
joined; each hit is extended word by word to both sides and counts if the equal run has 10 words or more. Items of
fewer than 10 words are one window of their own length, found by the hash of that many words.

Only DataFrame functions run here. A document's fingerprints leave it as (key, hash, position) alone; words come back
only to documents with hits. Benchmark texts that repeat are joined once. Each document's hits are united within one
row, so the work follows the number of hits. explode_outer stands where explode would do: for explode, the optimizer
infers a filter on the array's size and pushes it down through the projections, which computes them again inside of
the lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import small, stored, text_of

SPAN = 10
K = 5
W = SPAN - K + 1
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] with A-Z lower-cased; lower() serves where all is ASCII."""
    lowered = lambda x: F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))
    return F.transform(F.filter(F.split(text, SEPARATORS), lambda x: x != ""), lowered)


def _runs(hashes: str, length: int) -> Column:
    """The hash of each run of so many words; no runs: an empty array."""
    at = lambda i, d: F.get(F.col(hashes), i + d)
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - length), lambda i: F.xxhash64(*[at(i, d) for d in range(length)], F.lit(length)))
    return F.when(F.size(hashes) >= length, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, words_col: str, short: list[int]) -> DataFrame:
    """The frame with `_fp`: (h, p) of the winnowed runs, and of all runs of the given shorter lengths."""
    df = df.withColumn("_wh", F.transform(words_col, lambda x: F.xxhash64(x))).withColumn("_runs", _runs("_wh", K))
    placed = F.transform("_runs", lambda h, i: F.struct(h.alias("h"), (-i).alias("m")))
    df = df.withColumn("_placed", placed)
    least = F.transform(F.sequence(F.lit(1), F.size("_placed") - W + 1), lambda i: F.array_min(F.slice(F.col("_placed"), i, F.lit(W))))
    df = df.withColumn("_least", F.when(F.size("_placed") >= W, least).otherwise(F.array().cast("array<struct<h:bigint,m:int>>")))
    # a fingerprint is kept by windows in a row, so repeats are next to each other
    kept = F.filter("_least", lambda x, i: (i == 0) | (F.get(F.col("_least"), i - 1)["m"] != x["m"]))
    every = [F.transform(kept, lambda x: F.struct(x["h"].alias("h"), (-x["m"]).alias("p"), F.lit(SPAN).alias("size")))]
    for n in short:
        df = df.withColumn(f"_short{n}", _runs("_wh", n))
        every.append(F.transform(f"_short{n}", _sized(n)))
    return df.withColumn("_fp", F.concat(*every))


def _sized(n: int):
    return lambda h, i: F.struct(h.alias("h"), i.alias("p"), F.lit(n).alias("size"))


def _context(words_col: Column, at: Column, size: Column) -> Column:
    """The words around a hit: 15 for a winnowed run, its own for a short item; null beyond the text's ends."""
    long = F.transform(F.sequence(F.lit(-W + 1), F.lit(SPAN - 1)), lambda d: F.when(at + d >= 0, F.get(words_col, at + d)))
    return F.when(size == SPAN, long).otherwise(F.slice(words_col, at + 1, F.greatest(size, F.lit(1))))


def _equal_run(a: str, b: str) -> tuple[Column, Column]:
    """How far words are equal to the left and to the right of the run itself (null if the run differs)."""
    same = lambda i: F.coalesce(F.col(a)[i] == F.col(b)[i], F.lit(False))
    lefts = rights = F.lit(W - 1)
    for d in reversed(range(W - 1)):
        lefts = F.when(~same(W - 2 - d), F.lit(d)).otherwise(lefts)
        rights = F.when(~same(W - 1 + K + d), F.lit(d)).otherwise(rights)
    own = same(W - 1)
    for d in range(1, K):
        own = own & same(W - 1 + d)
    return F.when(own, lefts), F.when(own, rights)


def items(benchmark: DataFrame) -> DataFrame:
    """Distinct benchmark texts with words: _item (a number), _ids (their item_ids as strings), _iw (words)."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"))
    return own.groupBy("text").agg(F.collect_set("item_id").alias("_ids")).withColumn("_iw", words(F.col("text"))).where(F.size("_iw") > 0).select(F.xxhash64(F.array_join("_iw", " ")).alias("_item"), "_ids", "_iw")


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents with hits: _key, _th (their key and text hash, equal for repeated rows), n_hit, _ids (item ids)."""
    bench = items(benchmark)
    bench = bench.groupBy("_item", "_iw").agg(F.array_distinct(F.flatten(F.collect_list("_ids"))).alias("_ids"))
    bench = stored(bench.withColumn("_size", F.least(F.size("_iw"), F.lit(SPAN))))
    short = sorted(r[0] for r in bench.where(F.col("_size") < SPAN).select("_size").distinct().collect())  # at most 9 numbers
    prints = fingerprints(bench, "_iw", short).select("_item", "_iw", "_size", F.explode_outer("_fp").alias("f")).where("f is not null")
    prints = prints.where((F.col("f.size") == F.col("_size")) & ((F.col("f.size") == SPAN) | (F.col("f.p") == 0)))
    prints = stored(prints.select("_item", F.col("f.h").alias("h"), F.col("f.p").alias("q"), F.col("f.size").alias("size"), _context(F.col("_iw"), F.col("f.p"), F.col("f.size")).alias("_ic")))
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    marks = fingerprints(rows.withColumn("_dw", words(F.col("_text"))), "_dw", short).select("_key", "_th", F.explode_outer("_fp").alias("f")).where("f is not null").select("_key", "_th", F.col("f.h").alias("h"), F.col("f.p").alias("p"), F.col("f.size").alias("size"))
    met = marks.join(small(prints.select("_item", "h", "q", "size")), ["h", "size"])
    met = stored(met.groupBy("_key", "_th").agg(F.collect_set(F.struct("_item", "p", "q", "size")).alias("met")))
    # texts come back for the documents with hits alone; repeated rows count once
    same = lambda x, y: x["_key"].eqNullSafe(y["_k"]) & (x["_th"] == y["_h"])
    keyed = met.select(F.col("_key").alias("_k"), F.col("_th").alias("_h"), "met")
    few = small(keyed.select("_k", "_h"))
    back = rows.join(few, same(rows, few), "left_semi").dropDuplicates(["_key", "_th"])
    back = back.join(keyed, same(back, keyed)).withColumn("_dw", words(F.col("_text")))
    near = back.select("_key", "_th", F.explode_outer(F.transform("met", lambda m: F.struct(m["_item"].alias("_item"), m["p"].alias("p"), m["q"].alias("q"), m["size"].alias("size"), _context(F.col("_dw"), m["p"], m["size"]).alias("_dc")))).alias("m")).select("_key", "_th", "m.*")
    both = near.join(small(prints.select("_item", "q", "size", "_ic")), ["_item", "q", "size"])
    left, right = _equal_run("_dc", "_ic")
    long = (F.col("size") == SPAN)
    both = both.withColumn("_l", F.when(long, left)).withColumn("_r", F.when(long, right))
    both = both.withColumn("_from", F.when(long, F.col("p") - F.col("_l")).otherwise(F.col("p"))).withColumn("_to", F.when(long, F.col("p") + K + F.col("_r")).otherwise(F.col("p") + F.col("size")))
    true = both.where(F.when(long, F.col("_to") - F.col("_from") >= SPAN).otherwise(F.col("_dc") == F.col("_ic")))
    found = true.groupBy("_key", "_th").agg(F.sort_array(F.collect_set(F.struct("_from", "_to"))).alias("spans"), F.collect_set("_item").alias("_items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["_to"] - F.greatest(s["_from"], a["end"]))).alias("n"), F.greatest(a["end"], s["_to"]).alias("end")))
    found = found.withColumn("n_hit", covered["n"].cast("long")).drop("spans")
    named = found.select("_key", "_th", F.explode("_items").alias("_item")).join(small(bench.select("_item", "_ids")), "_item")
    named = named.groupBy("_key", "_th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_ids")))).alias("_ids"))
    return found.select("_key", "_th", "n_hit").join(named.select(F.col("_key").alias("_k"), F.col("_th").alias("_h"), "_ids"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_th") == F.col("_h"))).select("_key", "_th", "n_hit", "_ids")


def _with_found(docs: DataFrame, benchmark: DataFrame, text: str, key: str) -> DataFrame:
    """`row`, a struct of the frame's columns, n_hit and _ids, both null without hits."""
    found = hits(docs, benchmark, text, key)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_own"), F.xxhash64(text_of(text)).alias("_own_th"))
    return rows.join(found, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_own_th") == F.col("_th")), "left")


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The frame, its columns, and n_hit (0 without hits) and item_ids (empty without); columns that are named so are
    replaced, others of any name pass through. Nulls, empty texts and empty tables have no hits; a null key is a key
    like others; repeated rows all get their hits. A very long text is searched whole, in its row."""
    rows = _with_found(docs, benchmark, text, key)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_hit", "item_ids")]
    return rows.select(*own, F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows without hits, their columns untouched."""
    return _with_found(docs, benchmark, text, key).where("n_hit is null").select("row.*")


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and the benchmark items found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    slim = docs.select("doc_id", F.size(F.filter(F.split(text_of(), SEPARATORS), lambda x: x != "")).cast("long").alias("n_words"), F.xxhash64(text_of()).alias("_dh"))
    out = slim.join(found, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("_dh") == F.col("_th")), "left")
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
