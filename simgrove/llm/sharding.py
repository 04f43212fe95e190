"""Operator 10: shards from a hierarchical tree of weighted hash draws.

A row descends region, rack and shard. At each node it reaches every child draws -ln(u) / weight with u hashed from the
row's key and the child's name alone, and the least draw wins, so a child wins in proportion to its weight. A node's
weight is the sum of its leaves. The tree is a literal table of each node's children, so a descent draws for the
children of three nodes, whatever the number of leaves. Changing weights inside one subtree changes the draws of the nodes on the path to it and of
no other node, so rows move only into or out of that subtree (law `key`: key and topology decide, nothing else).

Growing by one shard adds it as a region of its own: at the top level one more child draws, all other draws stay, and
so a row either stays where it is or goes to the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simgrove.llm.common import stored, text_of


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: Regions x racks x shards of the first topology; further shards are regions of their own.
BASE = (2, 2, 4)


def topology(shards: int) -> list[Leaf]:
    """The leaves for so many shards of equal weight."""
    regions, racks, width = BASE
    leaves = []
    for n in range(shards):
        if n < regions * racks * width:
            leaves.append(Leaf(f"r{n // (racks * width)}", f"k{n // width % racks}", n))
        else:
            leaves.append(Leaf(f"x{n}", "k0", n))
    return leaves


def _draw(key: Column, child: Column) -> Column:
    """An exponential draw with the child's weight as its rate; the 53 upper hash bits make u in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / child["weight"]


def _children(leaves: list[Leaf]) -> dict[str, list[tuple[str, float]]]:
    """Each inner node's children and their weights; a node's name is its path, the root's is empty."""
    weights: dict[str, dict[str, float]] = {}
    for x in leaves:
        if x.weight > 0:
            path = ["", x.region, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"]
            for up, down in zip(path, path[1:], strict=False):
                own = weights.setdefault(up, {})
                own[down] = own.get(down, 0.0) + x.weight
    return {up: sorted(own.items()) for up, own in weights.items()}


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that a key's descent ends in; a null key counts as a key of its own."""
    if not leaves or any(x.weight < 0 for x in leaves) or not any(x.weight > 0 for x in leaves):
        raise ValueError("a tree needs leaves, weights of 0 or more and one above 0")
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    child = lambda name, weight: F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"))
    table = _children(leaves)
    tree = F.create_map(*[x for up, own in table.items() for x in (F.lit(up), F.array(*[child(*c) for c in own]))])
    # a lambda's variable holds the node, so that the levels below don't spell the descent out again
    least = lambda node: F.array_min(F.transform(F.element_at(tree, node), lambda c: F.struct(_draw(key, c).alias("d"), c["name"].alias("name"))))["name"]
    at = F.array(F.lit(""))
    for _ in range(3):
        at = F.transform(at, least)
    return F.element_at(F.split(at[0], "/"), -1).cast("int")


def place(df: DataFrame, leaves: list[Leaf], key: str = "doc_id") -> DataFrame:
    """The frame's rows with `shard` and `slot`, the row's place in its shard, gapless from 0; columns of these names are
    replaced, others of any name pass through.

    Slots number stretches of a shard, dealt by a salt of the row; as many stretches as give each shuffle partition four,
    so that no task sorts a whole shard. The counts of the stretches, a row each, give where each begins. Equal keys tie
    in any order, repeated rows get slots of their own, a null key is a key too; no rows, no slots. A very long value
    stays in its row.
    """
    stretches = max(1, -(-4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(leaves)))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(stretches)).cast("int")
    own = [c for c in df.columns if c not in ("shard", "slot")]
    rows = stored(df.select(F.struct(*own).alias("row"), F.col(key).alias("key"), shard_of(F.col(key), leaves).alias("shard"), salt.alias("stretch")))
    counts = stored(rows.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "stretch").orderBy("key")
    numbered = rows.withColumn("number", F.row_number().over(inside))
    # a row for each stretch: four for each shuffle partition, or one for each shard
    placed = numbered.join(F.broadcast(begins), ["shard", "stretch"])
    return placed.select("row.*", "shard", (F.col("begin") + F.col("number") - 1).cast("long").alias("slot"))


def op10_weighted_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, and where 17 would put them. Null text: size 1, checksum 0; null doc_id: a key too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.encode(text_of(), "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), topology(17)).alias("grown_shard"),
    )
    return place(rows, topology(16)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
