"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A hash of a document's id, text and source deals a source's documents into blocks
and orders them within a block; so all words of the source stand on one line, in a
random but repeatable order. A target of r times the source's words asks for so many
draws of blocks: whole passes over the line and, in a last pass, the blocks that
begin before the rest is filled. Of the last of these, the documents whose middle
lies before that point count.

How many of these draws each output shard gets is decided by a binary tree over the
shards: each node deals its exact quota vector to its two halves by one multivariate
hypergeometric draw, so that every shard is a fair sample and the quotas add up
exactly. Shards then take disjoint runs of each source's draws; a document is taken
once for each shard's draw of its block, and a hash orders the rows within a shard.

Texts aren't shuffled: the table of blocks, of bounded size, goes to all tasks, and
only documents of the blocks where a source's rest ends are looked up one by one.

Edge cases: a null text has size 0; documents of size 0 are drawn with their block
and take no words. A null source is a source of its own, ordered last. With no words
at all every target is 0. Rows equal in id, text and source are drawn alike, each
as a row. An empty table gives an empty mix. The mix's own columns get a leading
``_`` if the input has such a name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import fresh, stored

#: Blocks of a source; a block holds this share of its documents, whatever their number.
BLOCKS = 4096
#: Blocks of all sources that go to every task at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to targets: one row per source, with ``target``.

    Sources ordered by code point, null last, get the weights in turn and share
    ``volume`` times all sizes; a target stops at ``most`` times its source's
    size, and the excess is shared again by weight until none is above. In closed
    form: sources are filled in the order of their limit over their weight, and
    the first one whose even share stays within its limit fixes the level. The
    windows run over one row per source, not over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rest = W.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_n", (F.row_number().over(order) - 1) % len(weights))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_n") + 1).cast("int"))).withColumn("_limit", most * F.col("source_size"))
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = rest.rowsBetween(W.unboundedPreceding, -1)
    filled = ranked.withColumn("_all", volume * F.sum("source_size").over(whole))
    filled = filled.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))).withColumn("_weight", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    filled = filled.withColumn("_level", F.when(F.col("_left") / F.col("_weight") * F.col("_w") <= F.col("_limit"), F.col("_left") / F.col("_weight")))
    level = F.first("_level", ignorenulls=True).over(rest.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return filled.withColumn("target", F.least(F.col("_limit"), F.coalesce(level * F.col("_w"), F.col("_limit")))).select("source", "source_size", "target")


def _quota_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, draws) to (source, shard, draws) by levels of the splitting tree; one group is one node with a row per source."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        if high - low <= 1:
            return pdf[["source", "low", "high", "draws"]]
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        middle, total = (low + high) // 2, int(pdf["draws"].sum())
        rng, room, left = np.random.default_rng([seed, low, high]), total * (middle - low) // (high - low), []
        for n in pdf["draws"].astype(int):  # one marginal after the other: exact, and any number of sources
            total -= n
            got = int(rng.hypergeometric(n, total, room)) if n and room else 0
            room -= got
            left.append(got)
        halves = [pdf.assign(low=low, high=middle, draws=left), pdf.assign(low=middle, high=high, draws=pdf["draws"].to_numpy() - left)]
        return pd.concat(halves)[["source", "low", "high", "draws"]]

    nodes = quotas.select("source", F.lit(0).alias("low"), F.lit(shards).alias("high"), "draws")
    for _ in range(int(np.ceil(np.log2(max(1, shards))))):
        nodes = nodes.groupBy("low", "high").applyInPandas(split, "source string, low int, high int, draws long")
    return nodes.select("source", F.col("low").alias("shard"), "draws")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: list) -> DataFrame:
    """(row, size, source, h, block) of each document; row holds the ``carry`` columns."""
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), words(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), h.alias("h"))
    return rows.withColumn("block", F.pmod("h", F.lit(BLOCKS)).cast("int"))


def _blocks(rows: DataFrame, weights: tuple[float, ...], volume: float, most: float, shards: int, seed: int) -> DataFrame:
    """A row per block (_source, _block): source_size, target, start, rest, the ``shards`` that draw it, and whether the source's rest ends in it."""
    per_block = rows.groupBy("source", "block").agg(F.sum("size").alias("n"))
    aims = targets(per_block.groupBy("source").agg(F.sum("n").alias("source_size")), weights, volume, most).withColumnRenamed("source", "_s")
    line = W.partitionBy("source").orderBy("block")
    blocks = per_block.withColumn("start", F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("rank", F.row_number().over(line) - 1).withColumn("count", F.count("*").over(W.partitionBy("source")))
    blocks = blocks.join(aims, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = blocks.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    blocks = blocks.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    blocks = stored(blocks.withColumn("drawn", F.col("passes") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)))
    # Draws are numbered pass by pass in the order of the blocks; the shards take runs of these numbers.
    quotas = blocks.groupBy("source").agg(F.sum("drawn").cast("long").alias("draws"))
    ends = _quota_tree(quotas, shards, seed).withColumn("end", F.sum("draws").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
    runs = ends.groupBy(F.col("source").alias("_s")).agg(F.array_sort(F.collect_list("end")).alias("ends"))
    dealt = blocks.join(runs, F.col("source").eqNullSafe(F.col("_s")), "left")
    numbers = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda k: k * F.col("count") + F.col("rank"))
    numbers = F.filter(numbers, lambda x: x < F.element_at("ends", -1))
    drawn = F.transform(numbers, lambda x: F.size(F.filter("ends", lambda e: e <= x)))
    cut = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("n") > F.col("rest"))
    return stored(dealt.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "source_size", "target", "start", "rest", drawn.alias("shards"), cut.alias("cut")))


def _drawn(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows with source_size, target and ``shards``, one for each time that the row is drawn."""
    few = F.broadcast if blocks.count() <= MOST_BROADCAST else lambda df: df
    on = lambda part: rows.join(few(part), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    whole, part = on(blocks.where("NOT cut")), on(blocks.where("cut"))
    # The documents of a block where the rest ends, a row for each hash, on the block's piece of the line.
    units = part.groupBy("source", "block", "h").agg(F.sum("size").alias("s"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    line = W.partitionBy("source", "block").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    beyond = units.withColumn("at", F.sum("s").over(line) - F.col("s")).where("start + at + s / 2 >= rest").select(F.col("source").alias("_of"), F.col("h").alias("_h"))
    last = F.slice("shards", 1, F.size("shards") - 1)
    part = part.join(beyond, F.col("source").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_h")), "left").withColumn("shards", F.when(F.col("_h").isNull(), F.col("shards")).otherwise(last))
    columns = ["row", "size", "h", "source_size", "target", "shards"]
    return whole.select(*columns).unionAll(part.select(*columns))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), volume: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """The mix: a row per drawn copy, with the ``carry`` columns (all by default).

    Adds mix_size, mix_source_size, mix_target, mix_copy (from 0), mix_shard and
    mix_order (a row's place in its shard is its rank by this number).
    """
    carry = docs.columns if carry is None else carry
    rows = _rows(docs, id_col, text_col, source_col, seed, carry)
    each = _drawn(rows, _blocks(rows, weights, volume, most, shards, seed)).select("*", F.posexplode("shards").alias("copy", "shard"))
    own = {"size": "size", "source_size": "source_size", "target": "target", "copy": "copy", "shard": "shard", "order": F.xxhash64(F.lit(seed + 1), "copy", "h")}
    return each.select("row.*", *[(F.col(c) if isinstance(c, str) else c).alias(fresh(docs, f"mix_{name}")) for name, c in own.items()])


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row, of repeated and null ids too: the id, size, source_size, target, taken, and the shards that take it."""
    rows = stored(_rows(docs, id_col, text_col, source_col, 7, [id_col]))
    each = _drawn(rows, _blocks(rows, (5, 2, 1), 1.5, 2.0, 16, 7))
    return each.select("row.*", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")
