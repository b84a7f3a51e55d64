"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

The ring has VNODES places for each shard. A row's place is the hash of its doc_id; it belongs to the arc of the next
virtual node clockwise, and goes to that node's shard, or, if that is full, to the shard of the next node further on that
isn't. The bound of a shard is its fair share of the rows, so counts are at most one apart (law ``rows``); shards below
rows mod shards have the one more. Keys enter in the order of the ring's arcs, and inside an arc by hash.

Where a row goes depends on the rows before it only through counts. So rows are counted by arc and sub-arc (a second hash
over the whole key, which splits the arc of a doc_id that many rows have); one fold over the counted arcs, whose number is fixed,
gives the ranges of ranks in each arc that go to each shard; and every row is numbered inside its sub-arc and looks up its
range. The rows are shuffled once, without their texts. No task sees more than a sub-arc, except rows equal in
doc_id, text and size, which nothing can tell apart: they share one and are only numbered there.

Defined results: a null text has size 8 and text_crc32 0 (as an empty one); a null doc_id has a place of its own on the ring;
repeated rows each get a slot; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import read_table

SHARDS = 24
VNODES = 64
SUB_ARCS = 16
CELL_BITS = 12  # the ring's first bits, by which a place finds the virtual nodes near it


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes in the order of the ring; more shards leave the places of the others alone."""
    places = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
              for s in range(shards) for v in range(vnodes)]
    return sorted(places)


def _ring_tables(spark: SparkSession, shards: int, vnodes: int) -> tuple[DataFrame, DataFrame]:
    """(cells, arcs): a cell of the ring has the virtual nodes that can follow a place in it; an arc has the shards in
    the order in which a key moves on. Their sizes depend on the parameters alone."""
    nodes = ring(shards, vnodes)
    cells: list[list[tuple[int, int]]] = [[] for _ in range(1 << CELL_BITS)]
    for arc, (place, _) in enumerate(nodes):
        cells[(place >> (64 - CELL_BITS)) + (1 << (CELL_BITS - 1))].append((place, arc))
    following = 0  # beyond the last node the ring begins again
    for cell in reversed(cells):
        first = cell[0][1] if cell else following
        cell.append(((1 << 63) - 1, following))
        following = first
    order = []
    for arc in range(len(nodes)):
        seen: dict[int, None] = {}
        for step in range(len(nodes)):
            seen.setdefault(nodes[(arc + step) % len(nodes)][1])
            if len(seen) == shards:
                break
        order.append((arc, list(seen)))
    return (spark.createDataFrame(list(enumerate(cells)), "cell int, nodes array<struct<place:bigint,arc:int>>"),
            spark.createDataFrame(order, "arc int, shards array<int>"))


def _fold(arcs: Column, total: Column, shards: int) -> Column:
    """Segments (arc, shard, from, to: ranks inside the arc; slot: of the first) in the order of the arcs."""
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                       lambda s: F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0))
    none = F.array().cast("array<struct<arc:int,shard:int,from:bigint,to:bigint,slot:bigint>>")
    start = F.struct(F.transform(room, lambda r: F.struct(r.alias("left"), F.lit(0).cast("long").alias("used"))).alias("room"),
                     none.alias("segments"))

    def arc_in(state, arc):
        def shard_in(inner, shard):
            at = F.element_at(inner["room"], shard + 1)
            take = F.least(at["left"], arc["n"] - inner["done"])
            segment = F.struct(arc["arc"].alias("arc"), shard.alias("shard"), inner["done"].alias("from"),
                               (inner["done"] + take).alias("to"), at["used"].alias("slot"))
            room = F.transform(inner["room"], lambda r, s: F.when(
                s == shard, F.struct((r["left"] - take).alias("left"), (r["used"] + take).alias("used"))).otherwise(r))
            return F.when(take > 0, F.struct(room.alias("room"), F.concat(inner["segments"], F.array(segment)).alias("segments"),
                                             (inner["done"] + take).alias("done"))).otherwise(inner)
        begin = F.struct(state["room"].alias("room"), none.alias("segments"), F.lit(0).cast("long").alias("done"))
        end = F.aggregate(arc["shards"], begin, shard_in)
        return F.struct(end["room"].alias("room"), F.concat(state["segments"], end["segments"]).alias("segments"))
    return F.aggregate(arcs, start, arc_in, lambda state: state["segments"])


def sharded(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home: the shard of the row's own arc)."""
    cells, arcs = _ring_tables(docs.sparkSession, shards, vnodes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = (docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
             .withColumn("place", F.xxhash64("doc_id"))
             .withColumn("cell", (F.shiftright("place", 64 - CELL_BITS) + (1 << (CELL_BITS - 1))).cast("int"))
             .join(F.broadcast(cells), "cell")  # 2 ** CELL_BITS rows
             .withColumn("arc", F.element_at(F.filter("nodes", lambda v: v["place"] >= F.col("place")), 1)["arc"])
             .withColumn("sub", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SUB_ARCS)).cast("int"))
             .drop("cell", "nodes"))
    counts = keyed.groupBy("arc", "sub").agg(F.count("*").alias("n"))
    whole = (counts.groupBy("arc").agg(F.sum("n").alias("n")).join(F.broadcast(arcs), "arc")
             .groupBy().agg(F.array_sort(F.collect_list(F.struct("arc", "shards", "n"))).alias("arcs"),
                            F.sum("n").alias("total")).where("total > 0"))
    segments = (whole.select(F.explode(_fold(F.col("arcs"), F.col("total"), shards)).alias("s")).select("s.*")
                .groupBy("arc").agg(F.collect_list(F.struct("shard", "from", "to", "slot")).alias("segments")))
    before = Window.partitionBy("arc").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(segments, "arc")
    inside = Window.partitionBy("arc", "sub").orderBy("place", "doc_id", "text_crc32", "size")
    placed = (keyed.withColumn("number", F.row_number().over(inside) - 1).join(table, ["arc", "sub"])
              .withColumn("rank", F.col("before") + F.col("number"))
              .withColumn("s", F.element_at(F.filter("segments", lambda x: (x["from"] <= F.col("rank"))
                                                     & (F.col("rank") < x["to"])), 1))
              .join(F.broadcast(arcs.select("arc", F.element_at("shards", 1).alias("home"))), "arc"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s.shard").alias("shard"),
                         (F.col("s.slot") + F.col("rank") - F.col("s.from")).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "home")


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read_table(spark, sf_dir, "documents", "doc_id", "text"))
