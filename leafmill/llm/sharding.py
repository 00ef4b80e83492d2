"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has a fixed number of positions; every shard owns ``virtual_nodes`` of them, chosen by hash. A document's key (its id,
or its text where it has none) hashes to a position and belongs to the next virtual node clockwise; the positions that
lead to one node are its arc. Each shard has room for its exact share of the rows. What overflows a full shard continues
clockwise to the next node whose shard has room. A document's own shard goes before guests, so only the excess moves.

Rows of an arc are interchangeable but for their order, so the walk needs only the number of rows in each arc: it deals out
ranges of ranks (``arc, lo, hi``), a table bounded by the number of virtual nodes, whatever the number of rows.
A row's rank in its arc is the sum of three counts: of the cells before it (an arc is cut by hash into cells of some thousand rows), of
the groups before it in its cell, and of the equal rows before it in its group. A group is the rows of one id and text
within one block of 65,536 rows as read, so neither a hot id nor a hot group of copies meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.tables import parts, written

CELL_ROWS = 4096
BLOCK_BITS = 16


def nodes(spark: SparkSession, shards: int, virtual_nodes: int, positions: int) -> DataFrame:
    """The nodes of the ring in clockwise order: ``node`` (from 0), ``position, shard``. Of two on one position the one with the smaller hash stays."""
    number = F.col("id")
    dealt = spark.range(shards * virtual_nodes).select(F.expr(f"cast(id div {virtual_nodes} as int)").alias("shard"), F.xxhash64(F.lit("node"), F.expr(f"id div {virtual_nodes}"), F.pmod(number, F.lit(virtual_nodes))).alias("h"))
    placed = dealt.groupBy(F.pmod("h", F.lit(positions)).alias("position")).agg(F.min(F.struct("h", "shard"))["shard"].alias("shard"))
    return placed.withColumn("node", F.row_number().over(Window.orderBy("position")) - 1)


def arcs(ring: DataFrame, positions: int) -> DataFrame:
    """``position, arc``: the node that each position of the ring leads to."""
    every = ring.sparkSession.range(positions).withColumnRenamed("id", "position").join(ring.select("position", "node"), "position", "left")
    ahead = Window.orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.select("position", F.coalesce(F.min("node").over(ahead), F.lit(0)).alias("arc"))


def quota(shard: Column, rows: int, shards: int) -> Column:
    """Room of a shard: the rows shared out so that quotas differ by one at most."""
    upto = lambda s: F.expr("1L") * s * F.lit(rows // shards) + F.floor(s * F.lit(rows % shards) / F.lit(shards))
    return (upto(shard.cast("long") + 1) - upto(shard.cast("long"))).cast("long")


def walk(loads: DataFrame, ring: DataFrame, rows: int, shards: int) -> DataFrame:
    """Deal out the ``loads`` (``arc, n``) of the ring: ``arc, lo, hi, shard, round`` for every range of ranks that goes to one shard.

    Ranges arrive at nodes in rounds. A shard takes what it has room for in the order of arcs; the rest goes on to the
    next node whose shard still has room. A round with a rest fills a shard, so there are at most ``shards`` rounds.
    """
    free = written(ring.select("shard").distinct().withColumn("free", quota(F.col("shard"), rows, shards)), "ring-free")
    if free.count() < shards:
        raise ValueError("a shard has no virtual node of its own: take more positions or virtual nodes")
    waiting = loads.where("n > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.col("arc").alias("node"))
    arriving = Window.partitionBy("shard").orderBy("arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    rounds: list[DataFrame] = []
    while True:
        owned = ring.select("node", "shard").join(F.broadcast(free), "shard")  # a row for each shard
        before = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(arriving), F.lit(0))
        take = F.greatest(F.lit(0), F.least(F.col("hi") - F.col("lo"), F.col("free") - before)).cast("long")
        met = waiting.join(F.broadcast(owned), "node").withColumn("cut", F.col("lo") + take)  # a row for each node
        met = written(met.withColumn("round", F.lit(len(rounds))), "ring-round")
        rounds.append(met)
        left = met.where("cut < hi")
        if left.isEmpty():
            break
        used = met.groupBy("shard").agg(F.sum(F.col("cut") - F.col("lo")).alias("used"))
        free = written(free.join(used, "shard", "left").select("shard", (F.col("free") - F.coalesce("used", F.lit(0))).alias("free")), "ring-free")
        open_nodes = ring.join(F.broadcast(free), "shard").withColumn("usable", F.when(F.col("free") > 0, F.col("node")))
        onward = open_nodes.select("node", F.coalesce(F.min("usable").over(later), F.min("usable").over(Window.partitionBy())).alias("next"))
        waiting = left.join(F.broadcast(onward), "node").select("arc", F.col("cut").alias("lo"), "hi", F.col("next").alias("node"))
    dealt = rounds[0]
    for more in rounds[1:]:
        dealt = dealt.unionByName(more)
    return dealt.where("cut > lo").select("arc", "lo", F.col("cut").alias("hi"), "shard", "round")


def ranked(rows: DataFrame, total: int, arc_count: int) -> tuple[DataFrame, DataFrame]:
    """From ``row, h, arc`` the rank of each row in its arc (``row, arc, rank``) and the loads of the arcs (``arc, n``)."""
    subs = parts(total, CELL_ROWS * arc_count)
    cell, group = ["arc", "sub"], ["arc", "sub", "h", "block"]
    told = rows.withColumn("sub", F.pmod(F.shiftright("h", 17), F.lit(subs))).withColumn("block", F.shiftright("row", BLOCK_BITS))
    groups = told.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    cells = groups.groupBy(cell).agg(F.sum("n").alias("n"))
    before = lambda *order: (lambda keys: Window.partitionBy(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select(*cell, F.coalesce(F.sum("n").over(before("sub")("arc")), F.lit(0)).alias("cell_start"))
    placed = groups.withColumn("group_start", F.coalesce(F.sum("n").over(before("h", "block")(cell)), F.lit(0))).join(starts, cell)
    nth = F.row_number().over(Window.partitionBy(group).orderBy("row")) - 1
    told = told.withColumn("nth", nth).join(placed, group)
    return told.select("row", "arc", (F.col("cell_start") + F.col("group_start") + F.col("nth")).alias("rank")), cells.groupBy("arc").agg(F.sum("n").alias("n"))


def shard_documents(docs: DataFrame, shards: int = 8, virtual_nodes: int = 128, positions: int = 1 << 17, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, home, shard, slot`` for every row: the shard that the ring alone would give, the shard it gets, and its place there from 0.

    Numbers of rows in the shards differ by one at most. A further shard takes about its share of rows into itself; besides
    those only the overflow moves. Rows without an id take their text as key; null texts stay null and count like empty
    ones. Rows that repeat an id are separate rows with one home, so many of them overflow; rows that repeat id and text are
    interchangeable. The result does not depend on the order of the rows beyond that. An empty table gives an empty table. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    if not 0 < shards * virtual_nodes <= positions // 4:
        raise ValueError("the ring needs at least four positions for each virtual node")
    ident, text = F.col(id_column).cast("long"), F.col(text_column).cast("string")
    content = F.xxhash64(F.coalesce(ident, F.lit(0)), F.coalesce(text, F.lit("")), text.isNull())
    key = F.when(ident.isNull(), F.xxhash64(F.lit("text"), F.coalesce(text, F.lit("")))).otherwise(F.xxhash64(F.lit("id"), ident))
    base = written(docs.select(ident.alias("doc_id"), text.alias("text"), content.alias("h"), F.pmod(key, F.lit(positions)).alias("position"), F.monotonically_increasing_id().alias("row")), "ring-rows")
    ring = written(nodes(spark, shards, virtual_nodes, positions), "ring")
    leads = written(arcs(ring, positions), "ring-arcs")
    total = base.count()
    told = base.select("row", "h", "position").join(leads, "position").drop("position")
    ranks, loads = ranked(told, total, shards * virtual_nodes)
    dealt = written(walk(written(loads, "ring-loads"), ring, total, shards), "ring-dealt")
    inside = Window.partitionBy("shard").orderBy("arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("first", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(inside), F.lit(0)))
    dealt = dealt.join(ring.select(F.col("node").alias("arc"), F.col("shard").alias("home")), "arc")
    # a range for each arc, and one more for each shard that a round filled
    found = ranks.join(F.broadcast(dealt), (ranks["arc"] == dealt["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    found = found.select("row", "home", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))
    return base.select("row", "doc_id", "text").join(found, "row").select("doc_id", "text", "home", "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the documents as one folder of Parquet files for each shard, in the order of their slots."""
    sharded = shard_documents(docs, **options)
    shares = parts(sharded.count(), 1 << 20)
    sharded.repartitionByRange(shares, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
