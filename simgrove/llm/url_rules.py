"""Operator 2: URL verdicts from hand-written prefix rules and from mined association rules.

The hand-written rules come first: a rule fits its host and all subdomains if the path starts with the rule's, and the
longest rule wins. For all other URLs, combinations of URL tokens are mined over the labelled pages, by projections of
the pages to a token and the more frequent ones before it. Token sets that imply a label with enough confidence and
support, and better than the label's own share, are rules. They are matched by an inverted index: each rule hangs at its
token that the fewest pages have, so a page meets only the rules whose rarest token it has, and then all their tokens
are asked for.

All tokens of a URL are mined, and sets of any size. The number of token sets doubles with each token that always comes
along, so only rules that can win a page are looked for. Tokens that the same labelled pages have count as one, in rules
and in the pages that these meet (the least stands for them). A rule never wins if a part of it is as sure with as much
support; so a token is left out where it takes away no page of the other label, as every set with it loses to the same
set without it, and a set isn't extended where even all its further tokens together leave too many pages of the other
label to be surer than a part already found. What is left is searched to the end, however long that takes. The rules
are a table in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simgrove.llm.common import stored, with_few

#: Fixed values: (verdict, host, path).
PREFIX_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Least share of the labelled pages and least confidence of a mined rule; what pages get that no rule fits.
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.005, 0.75, "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def prefix_rule(host: Column, path: Column, rules=PREFIX_RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as `host/path`, and its verdict; both null if none fits."""
    best = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best, verdict = F.when(fits, h + p).otherwise(best), F.when(fits, kind).otherwise(verdict)
    return best, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: scheme, each domain suffix, host labels, path segments (digits as 0) and query keys."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    say = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    every = F.concat(F.array(F.concat(F.lit("s:"), F.regexp_extract(url, "^([A-Za-z]*)://", 1))), say("h:", F.filter(labels, lambda x: x != "")), say("p:", parts), say("q:", keys))
    return F.array_sort(F.array_distinct(every))


def _standing(data: DataFrame, least: int) -> DataFrame:
    """(token, stands, rank) of (tx, items): for each token of `least` transactions or more the one that stands for it,
    the least of those that the same transactions have, and that one's rank by its transactions, most first."""
    spread = data.select("tx", F.explode("items").alias("token"))
    tokens = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("tx")).alias("x"), F.bit_xor(F.xxhash64("tx", F.lit(1))).alias("y"))
    tokens = stored(tokens.where(F.col("n") >= least))
    one = tokens.groupBy("n", "x", "y").agg(F.min("token").alias("stands"))
    one = one.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "stands")))  # at most a URL's tokens / least share
    return tokens.join(one, ["n", "x", "y"]).select("token", "stands", "rank")


def _sure(last: int, row: np.ndarray, token: np.ndarray, right: np.ndarray, wrong: np.ndarray, marks: np.ndarray, totals: tuple[int, int], least: int, floor: float):
    """(antecedent, right pages, wrong pages, their mark) of the rules for a label with the token `last` that may win a
    page. Of the transactions with `last`: the row and token of each other token, rows ascending; how many pages of this
    label and of the other each row stands for, and its mark, a hash. totals: all pages of both."""
    r, w = int(right.sum()), int(wrong.sum())
    if r < least or w == totals[1]:
        return

    def rule(r, w):
        return (r / (r + w) >= floor) & (r * sum(totals) > (r + w) * totals[0])

    best = 0.0
    if rule(r, w):
        best = r / (r + w)
        yield (last,), r, w, int(np.bitwise_xor.reduce(marks))
    names, token = np.unique(token, return_inverse=True)
    # a set, and its transactions' other tokens as places in names; or those of its parent and the place to go to
    todo = [((last,), names, row, token, right, wrong, marks, best, None)] if w else []
    while todo:
        have, names, row, token, right, wrong, marks, best, place = todo.pop()
        if place is not None:
            own = np.zeros(len(right), bool)
            own[row[token == place]] = True
            further = own[row] & (token > place)
            row, token = (np.cumsum(own) - 1)[row[further]], token[further]
            have, right, wrong, marks = (*have, int(names[place])), right[own], wrong[own], marks[own]
        rs = np.bincount(token, right[row], len(names)).astype(np.int64)
        ws = np.bincount(token, wrong[row], len(names)).astype(np.int64)
        use = np.flatnonzero((rs >= least) & (ws < wrong.sum()))
        if not len(use):
            continue
        use = use[np.argsort(ws[use], kind="stable")]
        rs, ws, names = rs[use], ws[use], names[use]
        places = np.full(int(token.max()) + 1, -1)
        places[use] = np.arange(len(use))
        token = places[token]
        row, token = row[token >= 0], token[token >= 0]
        good = rule(rs, ws) & (rs / (rs + ws) > best)
        for i in np.flatnonzero(good):
            yield (*have, int(names[i])), int(rs[i]), int(ws[i]), int(np.bitwise_xor.reduce(marks[row[token == i]]))
        # a set with a token and some after it is at best as sure as if it lost all wrong pages but those with every one
        # of these; a row has every token from the place where its unbroken run to the last one begins
        by_row = np.lexsort((-token, row))
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        run = np.bincount(row, token[by_row] == len(use) - 1 - nth, len(wrong)).astype(np.int64)
        stay = np.cumsum(np.bincount(len(use) - run, wrong, len(use) + 1))[:-1].astype(np.int64)
        top = np.where(good, rs / (rs + ws), best)
        more = (ws > 0) & rule(rs, stay) & (rs / (rs + stay) > top)
        todo += [(have, names, row, token, right, wrong, marks, float(top[i]), i) for i in np.flatnonzero(more[:-1])]


SURE = "antecedent array<int>, verdict string, right long, wrong long, mark long"


def _sure_rules(totals: dict[str, int], least: int, floor: float):
    """For applyInArrow over (last, before, allow, block, mark) by last: the rules whose rarest token is last."""
    import pyarrow as pa

    def run(key, table):
        before = table.column("before").combine_chunks()
        row = np.repeat(np.arange(len(before)), before.value_lengths().to_numpy(zero_copy_only=False))
        token = before.flatten().to_numpy(zero_copy_only=False)
        pages, marks = {k: table.column(k).to_numpy() for k in totals}, table.column("mark").to_numpy()
        found = []
        for verdict, other in (("allow", "block"), ("block", "allow")):
            sure = _sure(key[0].as_py(), row, token, pages[verdict], pages[other], marks, (totals[verdict], totals[other]), least, floor)
            found += [(have, verdict, r, w, mark) for have, r, w, mark in sure]
        kinds = [pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*found)) or [[]] * len(kinds)
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["antecedent", "verdict", "right", "wrong", "mark"])

    return run


RULE = "antecedent array<string>, verdict string, confidence double, support double, lift double"


def mine(transactions: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """From (items, verdict), tables of rules (antecedent, verdict, confidence, support, lift) and of tokens (token,
    stands): a rule fits a page whose tokens' stands hold its antecedent. All rules that can win a page are there, and
    none of the same pages as a part of it. No labelled rows: none of both."""
    spark = transactions.sparkSession
    data = stored(transactions.select(F.array_distinct("items").alias("items"), "verdict").withColumn("tx", F.monotonically_increasing_id()))
    totals = {"allow": 0, "block": 0} | {r.verdict: r["count"] for r in data.groupBy("verdict").count().collect()}  # two rows
    n = sum(totals.values())
    if not n:
        return spark.createDataFrame([], RULE), spark.createDataFrame([], "token string, stands string")
    least = max(1, math.ceil(min_support * n))
    stands = stored(_standing(data, least))
    ranks = stored(stands.where("token = stands").select("token", "rank"))
    met = with_few(data.select("tx", "verdict", F.explode("items").alias("token")), ranks, "token")
    each = met.groupBy("tx", "verdict").agg(F.sort_array(F.collect_list("rank")).alias("items"))  # a URL's tokens
    count = [F.sum(F.when(F.col("verdict") == k, 1).otherwise(0)).alias(k) for k in totals]
    sets = each.groupBy("items").agg(*count).select("*", F.xxhash64("items").alias("mark"), F.posexplode("items").alias("at", "last"))
    parts = sets.groupBy("last", F.slice("items", F.lit(1), F.col("at")).alias("before")).agg(*[F.sum(k).alias(k) for k in totals], F.bit_xor("mark").alias("mark"))
    # a token's few bytes may be long work: dealt to all slots
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "last")
    found = stored(parts.groupBy("last").applyInArrow(_sure_rules(totals, least, min_confidence), SURE))
    found = stored(found.withColumn("rule", F.monotonically_increasing_id()))
    same = ["verdict", "right", "wrong", "mark"]
    part = found.select(*same, F.col("antecedent").alias("part"))
    lost = found.join(part, same).where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    found = found.join(lost.select("rule").distinct(), "rule", "left_anti")
    named = with_few(found.select("rule", F.explode("antecedent").alias("rank")), ranks, "rank")
    named = named.groupBy("rule").agg(F.array_sort(F.collect_list("token")).alias("antecedent"))  # a rule's tokens
    rules = found.drop("antecedent").join(named, "rule")
    sure, share = F.col("right") / (F.col("right") + F.col("wrong")), F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, v / n)])
    return stored(rules.select("antecedent", "verdict", sure.alias("confidence"), (F.col("right") / n).alias("support"), (sure / share[F.col("verdict")]).alias("lift"))), stands.drop("rank")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(_page, rule verdict, confidence, antecedent) of the best rule for each page with one: surest, then most
    support, then most tokens, then the token list. pages: _page (unique), items."""
    spread = stored(rules.select(F.monotonically_increasing_id().alias("rule"), "*"))
    words = spread.select("rule", F.explode("antecedent").alias("token"))
    met = with_few(pages.select(F.explode("items").alias("token")), words.select("token").distinct(), "token")
    index = words.join(met.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token", "left")
    index = index.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    index = spread.join(index, "rule").select("token", "antecedent", F.col("verdict").alias("rule_verdict"), "confidence", "support")
    hits = with_few(pages.select("_page", "items", F.explode("items").alias("token")), index, "token")
    hits = hits.where(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max_by(F.struct("rule_verdict", "confidence", "antecedent"), F.struct("confidence", "support", F.size("antecedent"), F.array_join("antecedent", " ")))
    return hits.groupBy("_page").agg(best.alias("m")).select("_page", "m.*")


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the matching token set or null), confidence.

    A page's label comes from the row of labels with its id: block if any says toxic or poor quality. Repeated pages
    are judged each, by rules that repeated labelled pages count for each; null ids have no label, null URLs no tokens
    but an empty scheme. Empty labels: every page without a prefix rule gets the default; no pages, no verdicts. Rules
    tie as in match(). A URL of any length is matched whole. Other columns aren't read, whatever their names.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = prefix_rule(F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("items", tokens(F.col("host"), F.col("path"), F.col("url")))
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0))
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    training = rows.join(known, "page_id").select("items", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))
    # each distinct URL is matched once; their strings are dealt anew, as few bytes hold many of them
    urls = rows.where("rule is null").select(F.col("url").alias("_page")).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_path(F.col("_page"))
    rules, stands = mine(training)
    met = with_few(urls.select("_page", F.explode(tokens(host, path, F.col("_page"))).alias("token")), stands, "token")
    urls = stored(met.groupBy("_page").agg(F.array_sort(F.collect_set("stands")).alias("items")))  # a URL's tokens
    found = stored(match(urls, rules))
    out = rows.join(found.withColumnRenamed("_page", "url"), "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", "rule_verdict", F.lit(DEFAULT)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("antecedent")).alias("mined"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))


def op2_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, prefix rule and verdict."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return judge(spark, table("pages"), table("labels")).drop("mined", "confidence")
