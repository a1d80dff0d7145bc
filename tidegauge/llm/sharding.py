"""Sharding by balanced label propagation.

Items are linked through hubs: a hub is a set of items that should stand together
(here the documents with equal texts). All linked items begin in a shard drawn by
hash. In each round every hub counts by join what of it lies in which shard and
names the fullest one, or, where one is too small for it, the fullest that have
room; its other items ask to move there. The
requests between each two shards are summed, and quotas are derived from the sums:
what two shards swap may always move, beyond that only what the room allows.
Whether an item is within a quota is decided by hash, alike for all of a small
hub, so that hubs move whole; a hub that outgrows a shard is divided item by item.

Then what hangs above a shard's capacity is freed, and free items fill the shards
up: counts by size class are dealt on the driver from the largest class on to the
emptiest shards, and each class is divided by rank accordingly. Sizes end up even
within about one small item. Only tables of shards by shards and of size classes
reach the driver.

Cases: a null text counts as empty; repeated rows are items of their own, linked;
an item larger than a shard's share has its shard to itself as far as possible;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, query, table

SHARDS, ROUNDS = 16, 4
#: A hub below this share of a shard moves whole.
SMALL_HUB = 1 / 64
#: Size classes per doubling; rows that one task ranks.
CLASSES, RANKED = 32, 4096


def even(*columns: Column | str) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def ranked(rows: DataFrame, key: str, row: str, n: int, name: str) -> DataFrame:
    """Adds the place of every row among those of its ``key``, from 0 without gaps.

    Rows are dealt by key and hash, ranked in these parts, and moved on by the sizes
    of the parts before, so that no task holds a whole key.
    """
    parts = max(64, -(-n // RANKED))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(row), F.lit(parts)))
    sizes = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_part").orderBy(row)
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1).join(starts, [key, "_part"])
    return placed.withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_part", "_start", "_place")


def quotas(asked: dict[tuple[int, int], float], room: list[float], shards: int) -> list[float]:
    """Share of the requests from shard i to j that may move, at place i * shards + j."""
    into = [sum(asked.get((i, j), 0.0) for i in range(shards)) for j in range(shards)]
    out = []
    for i in range(shards):
        for j in range(shards):
            want = asked.get((i, j), 0.0)
            swap = min(want, asked.get((j, i), 0.0))
            beyond = sum(asked.get((x, j), 0.0) - min(asked.get((x, j), 0.0), asked.get((j, x), 0.0)) for x in range(shards)) if into[j] else 0.0
            extra = max(room[j], 0.0) * (want - swap) / beyond if beyond else 0.0
            out.append(min(1.0, (swap + extra) / want) if want else 0.0)
    return out


def propagate(links: DataFrame, capacity: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """row, size, hub, shard of linked items, from rows row, size, hub (a row per link; an item may have several)."""
    state = cut(links.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    for number in range(rounds):
        lying = cut(state.groupBy("hub", "shard").agg(F.sum("size").alias("held")))
        own = state.groupBy("row").agg(F.any_value("size").alias("size"), F.any_value("shard").alias("shard"))
        held = {r[0]: float(r[1]) for r in own.groupBy("shard").agg(F.sum("size")).collect()}
        room = [capacity - held.get(j, 0.0) for j in range(shards)]
        # a small hub gathers in its fullest shard; a larger one in as many as it needs, the fullest that have room
        open_ = F.get(F.array(*[F.lit(r > 0) for r in room]), F.col("shard"))
        small = F.col("whole") <= SMALL_HUB * capacity
        by_room = F.sort_array(F.collect_list(F.struct(open_.alias("open"), F.col("held"), (-F.col("shard")).alias("place"))), asc=False)
        by_fill = F.sort_array(F.collect_list(F.struct(F.col("held"), (-F.col("shard")).alias("place"))), asc=False)
        hubs = lying.groupBy("hub").agg(by_room.alias("by_room"), by_fill.alias("by_fill"), F.sum("held").alias("whole"))
        needed = F.ceil(F.col("whole") / F.lit(max(capacity, 1.0))).cast("int")
        best = F.when(small, F.slice(F.col("by_fill.place"), 1, 1)).otherwise(F.slice(F.col("by_room.place"), F.lit(1), needed))
        targets = F.transform(best, lambda x: (-x).cast("int"))
        wish = cut(hubs.select("hub", "whole", targets.alias("targets"), F.element_at("by_fill.held", 1).alias("weight")))
        strongest = state.join(wish, "hub").groupBy("row").agg(
            F.any_value("size").alias("size"),
            F.any_value("shard").alias("shard"),
            F.max_by(F.struct("targets", "hub", "whole"), F.struct("weight", "hub")).alias("to"),
        )
        asks = strongest.select("row", "size", "shard", "to.*")
        drawn_target = F.get("targets", F.pmod(F.xxhash64("row", F.lit(f"to {number}")), F.size("targets").cast("long")).cast("int"))
        asks = asks.withColumn("wish", F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(drawn_target))
        asks = cut(asks.drop("targets"))
        wanted = asks.filter("wish <> shard").groupBy("shard", "wish").agg(F.sum("size"))
        asked = {(r[0], r[1]): float(r[2]) for r in wanted.collect()}
        if not asked:
            break
        share = F.get(F.array(*[F.lit(q) for q in quotas(asked, room, shards)]), F.col("shard") * shards + F.col("wish"))
        drawn = F.when(small, even("hub", F.lit(number))).otherwise(even("row", F.lit(number)))
        moved = asks.select("row", F.when((F.col("wish") != F.col("shard")) & (drawn < share), F.col("wish")).otherwise(F.col("shard")).alias("shard"))
        state = cut(state.drop("shard").join(moved, "row"))
    return state


def deal(classes: list[tuple[int, int, int]], loads: list[float]) -> list[tuple[int, int, int, int]]:
    """Ranges of ranks by size class: (class, first, last + 1, shard).

    ``classes`` are (class, count, bytes). From the largest class on, the items are
    counted out so that the loads come as near to each other as they can.
    """
    out, shards = [], len(loads)
    for number, count, total in sorted(classes, reverse=True):
        each = total / count
        order = sorted(range(shards), key=lambda j: (loads[j], j))
        level = 0.0
        for used in range(1, shards + 1):
            level = (total + sum(loads[j] for j in order[:used])) / used
            if used == shards or level <= loads[order[used]]:
                break
        given = [max(0, int((level - loads[j]) / each)) for j in range(shards)]
        while sum(given) > count:
            given[max(range(shards), key=lambda j: (given[j] > 0, loads[j] + given[j] * each))] -= 1
        for _ in range(count - sum(given)):
            given[min(range(shards), key=lambda j: (loads[j] + given[j] * each, j))] += 1
        first = 0
        for j, n in enumerate(given):
            if n:
                out.append((number, first, first + n, j))
                first += n
                loads[j] += n * each
    return out


def fill(free: DataFrame, loads: list[float], n: int) -> DataFrame:
    """row, shard of free items (row, size), so that the loads become even."""
    sized = free.withColumn("class", F.floor(F.log2(F.col("size")) * CLASSES).cast("int"))
    classes = [tuple(r) for r in sized.groupBy("class").agg(F.count(F.lit(1)), F.sum("size")).collect()]
    ranges = deal(classes, loads)
    spark = free.sparkSession
    if not ranges:
        return spark.createDataFrame([], "row long, shard int")
    # one range list per class: no more rows than size classes
    by_class: dict[int, list[tuple[int, int]]] = {}
    for number, _, last, shard in ranges:
        by_class.setdefault(number, []).append((last, shard))
    small = spark.createDataFrame([(c, [x for x, _ in r], [s for _, s in r]) for c, r in by_class.items()], "class int, ends array<long>, shards array<int>")
    placed = ranked(sized, "class", "row", n, "rank").join(F.broadcast(small), "class")
    upto = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    return placed.select("row", F.get("shards", upto).alias("shard"))


def shard_items(items: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds shard and slot to items row (unique), size, hub; rows must be a written table."""
    first = items.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, n = first[0] or 0, first[1]
    hubs = items.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("hub")
    state = propagate(items.join(cut(hubs), "hub").select("row", "size", "hub"), total / shards, shards, rounds)
    held = {r[0]: float(r[1]) for r in state.groupBy("shard").agg(F.sum("size")).collect()}
    over = [max(0.0, 1 - total / shards / held[j]) if held.get(j) else 0.0 for j in range(shards)]
    stays = cut(state.filter(even("hub", F.lit("freed")) >= F.get(F.array(*[F.lit(x) for x in over]), F.col("shard"))).select("row", "size", "shard"))
    held = {r[0]: float(r[1]) for r in stays.groupBy("shard").agg(F.sum("size")).collect()}
    free = items.select("row", "size").join(stays.select("row"), "row", "left_anti")
    filled = fill(cut(free), [held.get(j, 0.0) for j in range(shards)], n)
    placed = cut(stays.select("row", "shard").unionByName(filled))
    return ranked(items.join(placed, "row"), "shard", "row", n, "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; those with equal texts are linked."""
    whole = F.coalesce(F.col(text), F.lit(""))
    items = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("hub"),
    )
    return shard_items(cut(items), shards)


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
