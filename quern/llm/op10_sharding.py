"""Sharding by a hierarchical weighted hash tree.

A document descends from the root through region and rack to a shard. At each level every child draws ln(u) / weight, where u comes
from a hash of the document's id and the child's name, and the largest draw wins: children get documents in proportion to their
weight, and a draw depends on nothing but its own child. If the weight of a subtree grows, documents only move into it; if a new
shard stands in a region of its own, documents move into that shard alone. Law: `key`.

Slots number the documents of a shard from 0 without gaps: documents are dealt to small cells of a shard, numbered within their cell,
and cells are shifted by the counts of those before them, so no shard is ever sorted in one task.

Cases: a null id draws as the text `null`. Null text has size 1 and the CRC of no bytes. Repeated rows go to the same shard and get
slots of their own. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small

#: Documents of one cell, about.
CELL = 20_000


@dataclass(frozen=True)
class Branch:
    name: str
    weight: float
    children: tuple["Branch", ...] = field(default=())
    shard: int | None = None


def topology(shards: int, per_rack: int = 2, racks: int = 2, base: int = 16) -> Branch:
    """Shards 0 to base - 1, those the store began with, fill regions of `racks` racks of `per_rack` shards; every later shard opens a
    region of its own, so that the tree for one more shard differs only by a new subtree. The law `key` therefore holds between trees
    of `base` shards or more; a store that begins with fewer names its own base and keeps it."""
    leaves = [Branch(f"s{i}", 1.0, shard=i) for i in range(shards)]

    def group(kind: str, items: list[Branch], size: int) -> list[Branch]:
        groups = [items[i : i + size] for i in range(0, len(items), size)]
        return [Branch(f"{kind}{k}", sum(x.weight for x in g), tuple(g)) for k, g in enumerate(groups)]

    old, new = leaves[:base], leaves[base:]
    regions = group("region", group("rack", old, per_rack), racks)
    regions += [Branch(f"region-of-{x.name}", x.weight, (Branch(f"rack-of-{x.name}", x.weight, (x,)),)) for x in new]
    return Branch("root", sum(r.weight for r in regions), tuple(regions))


def draw(key: Column, child: Branch) -> Column:
    """ln(u) / weight with u in (0, 1) of 52 hash bits."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{child.name}"))), 1, 13), 16, 10).cast("double")
    return F.log((bits + 0.5) / float(1 << 52)) / child.weight


def place(key: Column, node: Branch) -> Column:
    """The shard that key reaches from node."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = [draw(key, c) for c in node.children]
    best = F.greatest(*draws)
    out = place(key, node.children[-1])
    for d, c in list(zip(draws, node.children))[-2::-1]:
        out = F.when(d == best, place(key, c)).otherwise(out)
    return out


def shard(docs: DataFrame, tree: Branch, doc_id: str = "doc_id") -> Column:
    """Column with the shard of each document."""
    return place(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), tree).cast("int")


def with_slots(placed: DataFrame, shard_column: str, order: list[str], cell: int = CELL) -> DataFrame:
    """placed (materialized) with slot, a gapless number from 0 within each shard; by cell, then by order."""
    cells = max(1, -(-placed.count() // cell))
    dealt = placed.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = materialize(dealt.groupBy(shard_column, "__cell").agg(F.count("*").alias("__n")), "cells")
    if counts.count() <= 100_000:
        before = F.coalesce(F.sum("__n").over(W.partitionBy(shard_column).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        shifts = counts.select(shard_column, "__cell", before.alias("__before"))
    else:  # cells in blocks of 10 000, shifted likewise
        block = F.floor(F.col("__cell") / 10_000)
        blocks = counts.groupBy(shard_column, block.alias("__b")).agg(F.sum("__n").alias("__n"))
        ahead = blocks.select(shard_column, "__b", F.coalesce(F.sum("__n").over(W.partitionBy(shard_column).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
        within = F.coalesce(F.sum("__n").over(W.partitionBy(shard_column, "__b").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        shifts = counts.withColumn("__b", block).join(ahead, [shard_column, "__b"]).select(shard_column, "__cell", (within + F.col("__ahead")).alias("__before"))
    numbered = dealt.withColumn("__at", F.row_number().over(W.partitionBy(shard_column, "__cell").orderBy(*order)) - 1)
    return numbered.join(small(shifts), [shard_column, "__cell"]).withColumn("slot", (F.col("__before") + F.col("__at")).cast("long")).drop("__cell", "__at", "__before")


def write_shards(docs: DataFrame, tree: Branch, path: str, doc_id: str = "doc_id") -> None:
    """Whole rows to path/shard=N; every task appends to the shards it meets, nothing is gathered."""
    docs.withColumn("shard", shard(docs, tree, doc_id)).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str, shards: int = 16) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    placed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard(docs, topology(shards)).alias("shard"), shard(docs, topology(shards + 1)).alias("grown_shard"),
    )
    out = with_slots(materialize(placed, "placed"), "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
