"""Merkle fixity audit of WARC records held by two replicas.

Records of both replicas stand in slots, one for each archive and key. A replica's
hash of a slot covers all records that it has there, in any order: hashes are
summed, so that records that share a key, however many, are combined before the
shuffle. The slots of an archive are numbered in the order of their keys and span
the offset ranges that the first replica's records take; the numbers come from
ranges of bounded size and a prefix sum, so no task sorts a whole archive.

Each replica's tree hashes runs of ``FAN`` children together with the range that
they span. Levels are written once (each is a sixteenth of the one below). The
audit compares the roots of the archives and goes down only where they differ,
level by level, until the slots are found.

Edge cases: a null payload is a lost record, which is as good as none and differs
from an empty one. Of records that share a key, one that differs, or a differing
number of them, makes the slot ``changed``. A slot that only the second replica
fills is ``extra`` and has an empty range. Null archives are one archive, null
keys one slot of each archive. Empty tables give an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import stored

FAN = 16
LOST = "lost"


def warc_record(uri: Column, payload: Column) -> Column:
    """The bytes of a response record; null if the payload is null."""
    body = payload.cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaf_hash(record: Column) -> Column:
    """Hexadecimal SHA-256; null for a lost record."""
    return F.sha2(F.concat(F.lit("record:").cast("binary"), record), 256)


def slots(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two replicas' (archive, key, size, hash) to (archive, key, size, n_a, n_b, a, b): sizes of the first, records and hashes of both."""
    cols = ("archive", "key", "size", "hash")
    rows = first.select(*cols, F.lit(True).alias("own")).unionAll(second.select(*cols, F.lit(False).alias("own")))
    part = lambda i: F.conv(F.substring("hash", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    rows = rows.select(*cols, "own", *[part(i).alias(f"h{i}") for i in range(4)])
    sums = [F.sum(F.when(F.col("own") == own, F.col(f"h{i}"))).alias(f"{x}{i}") for own, x in ((True, "a"), (False, "b")) for i in range(4)]
    counts = [F.count(F.when((F.col("own") == own) & F.col("hash").isNotNull(), 1)).alias(f"n_{x}") for own, x in ((True, "a"), (False, "b"))]
    size = F.coalesce(F.sum(F.when(F.col("own"), F.col("size"))), F.lit(0)).cast("long").alias("size")
    digest = lambda x: F.when(F.col(f"n_{x}") == 0, LOST).otherwise(F.sha2(F.concat_ws("+", f"n_{x}", *[f"{x}{i}" for i in range(4)]), 256)).alias(x)
    return rows.groupBy("archive", "key").agg(size, *counts, *sums).select("archive", "key", "size", "n_a", "n_b", digest("a"), digest("b"))


def placed(rows: DataFrame) -> DataFrame:
    """Slots with at, their number in the archive by key, and their offset range low to high."""
    ranged = stored(rows.repartitionByRange("archive", "key").withColumn("part", F.spark_partition_id()))
    within = W.partitionBy("part", "archive").orderBy("key")
    local = ranged.withColumn("at", F.row_number().over(within).cast("long") - 1).withColumn("high", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
    # A row for each archive and range that holds some of it.
    before = W.partitionBy("archive").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("part", "archive").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    starts = starts.select(F.col("part").alias("_part"), F.col("archive").alias("_archive"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "bytes")])
    both = local.join(starts, (F.col("part") == F.col("_part")) & F.col("archive").eqNullSafe(F.col("_archive")))
    high = F.col("high") + F.col("_bytes")
    return both.select("archive", (F.col("at") + F.col("_n")).alias("at"), (high - F.col("size")).alias("low"), high.alias("high"), "key", "n_a", "n_b", "a", "b")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of both trees: a node hashes its FAN children in order, with the offset range."""
    children = F.array_sort(F.collect_list(F.struct("at", "a", "b"))).alias("c")
    inner = nodes.groupBy("archive", F.floor(F.col("at") / FAN).alias("at")).agg(F.min("low").alias("low"), F.max("high").alias("high"), children)
    of = lambda x: F.sha2(F.concat_ws("|", F.lit("node"), "low", "high", F.transform("c", lambda child: child[x])), 256).alias(x)
    return inner.select("archive", "at", "low", "high", of("a"), of("b"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(archive, key, size, hash) rows of two replicas to (archive, at, low, high, key, status) of each slot that differs.

    status: changed; missing (nothing in the second replica); extra (nothing in the first).
    """
    levels = [stored(placed(slots(first, second)))]
    last = levels[0].agg(F.max("at")).first()[0]
    while last:
        levels.append(stored(parents(levels[-1])))
        last //= FAN
    bad = levels[-1].where("a != b")
    for level in reversed(levels[:-1]):
        up = bad.select(F.col("archive").alias("_up"), F.col("at").alias("_node"))
        bad = level.join(up, F.col("archive").eqNullSafe(F.col("_up")) & (F.floor(F.col("at") / FAN) == F.col("_node")), "left_semi").where("a != b")
    status = F.when(F.col("n_b") == 0, "missing").when(F.col("n_a") == 0, "extra").otherwise("changed")
    return bad.select("archive", "at", "low", "high", "key", status.alias("status"))
