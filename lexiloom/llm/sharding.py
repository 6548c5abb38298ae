"""Resharding by minimum-cost flow.

Rows lie in old shards and are to lie in new ones whose capacities are given
(here: equal bytes).  The cost of a byte is 0 where it stays in its shard and 1
where it moves.  What moves are groups, all rows of one text, so that equal
texts end in one shard.  A group's home is the old shard with most of its rows'
bytes.

1. Heavy groups, those of more than 1/``FINE`` of a new shard, are few
   (``FINE`` times the shards at most) and are placed by the driver, largest
   first: at home where there is room, else where there is most.  A group of
   more than 1/``WHOLE`` of a shard can't stay whole if shards are to be equal;
   it is dealt by id into parts of that size at most, each in one shard.
2. The other groups are laid out at their homes as lines of bytes, block after
   block.  The flow from the homes' sizes to the room that is left, on a graph
   of shards only, cuts each line into segments, and a group goes where the
   segment at its first byte goes.
3. Slots come from counts by shard and block (a bounded number of them) and the
   place of a row inside its block.

No row is joined by a hot key: heavy groups are broadcast, others are small.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

ROW_OVERHEAD = 8
BLOCKS_PER_SHARD = 256  # the driver sees shards x this many block sizes
FINE, WHOLE = 256, 4
FILE_BYTES = 256 << 20


def minimum_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """flow[i][j] from old shard i to new shard j, of least moved size.

    Successive shortest augmenting paths on source -> old -> new -> sink; arcs
    i -> i cost 0, others 1.  Supplies and capacities have equal sums.  Ties are
    broken by the smaller shard number.
    """
    if sum(supply) != sum(capacity):
        raise ValueError("old sizes and new capacities differ in sum")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford queue from all old shards with supply, over the residual graph.
        far = float("inf")
        cost_old = [0 if x else far for x in left]
        cost_new, came_new, came_old = [far] * m, [-1] * m, [-1] * n
        queue = deque(i for i in range(n) if left[i])
        while queue:
            i = queue.popleft()
            for j in range(m):
                step = cost_old[i] + (i != j)
                if step < cost_new[j]:
                    cost_new[j], came_new[j] = step, i
                    for k in range(n):
                        if flow[k][j] and cost_new[j] - (k != j) < cost_old[k]:
                            cost_old[k], came_old[k] = cost_new[j] - (k != j), j
                            queue.append(k)
        end = min((j for j in range(m) if room[j]), key=lambda j: (cost_new[j], j))
        path, j, amount = [], end, room[end]
        while True:
            i = came_new[j]
            path.append((i, j, 1))
            if came_old[i] < 0:
                amount = min(amount, left[i])
                break
            path.append((i, came_old[i], -1))
            amount = min(amount, flow[i][came_old[i]])
            j = came_old[i]
        for a, b, sign in path:
            flow[a][b] += sign * amount
        left[path[-1][0] if path[-1][2] > 0 else path[-2][0]] -= amount
        room[end] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", old: Column | None = None, old_shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, text_hash, old``: what sharding needs of each row."""
    text = F.col(text_col).cast("string")
    place = old if old is not None else F.pmod(F.xxhash64(F.col(id_col)), F.lit(old_shards))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("text_hash"),
        place.cast("int").alias("old"),
    )


def fill(loads: list[int], total: int) -> list[int]:
    """Room for ``total`` more that makes shards of these loads as equal as can be."""
    level, order = 0, sorted(loads)
    for k, load in enumerate(order):
        level = (sum(order[: k + 1]) + total) // (k + 1)
        if k + 1 == len(order) or level <= order[k + 1]:
            break
    room = [max(0, level - x) for x in loads]
    rest = total - sum(room)
    for j in sorted(range(len(loads)), key=lambda j: (loads[j] + room[j], j))[:rest]:
        room[j] += 1
    return room


def place_heavy(parts: list[tuple[int, int]], capacity: list[int]) -> list[int]:
    """Shard of each part (size, home), largest first: the home where it has room, else the shard with most room."""
    room, out = list(capacity), [0] * len(parts)
    for k in sorted(range(len(parts)), key=lambda k: (-parts[k][0], k)):
        size, home = parts[k]
        out[k] = home if home < len(room) and room[home] >= size else max(range(len(room)), key=lambda j: (room[j], -j))
        room[out[k]] -= size
    return out


def reshard(rows: DataFrame, new_shards: int, *, blocks: int = BLOCKS_PER_SHARD, fine: int = FINE, whole: int = WHOLE) -> DataFrame:
    """Assign ``shard`` and ``slot`` to rows made by :func:`measure`.

    Rows of equal texts get one shard, but for texts whose rows have more than
    1/``whole`` of a shard's bytes: these lie in as few shards as parts of that
    size allow.  Shard sizes differ by the cuts of the flow's segments, 1/``fine``
    of a shard each at most, and by a single row or heavy part where that is
    larger.  Slots count from 0 without gaps in each shard.  Null texts are
    equal and have the size of an empty row.  Repeated rows are rows of their
    own.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "shard-rows")
    at_home = rows.groupBy("text_hash", "old").agg(F.sum("size").alias("bytes"))
    groups = at_home.groupBy("text_hash").agg(F.sum("bytes").alias("bytes"), F.max_by("old", F.struct("bytes", -F.col("old"))).alias("home"))
    groups = materialize(groups.withColumn("block", F.pmod(F.xxhash64("text_hash"), F.lit(blocks)).cast("int")), "shard-groups")
    total = int(groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    capacity = equal_capacities(total, new_shards)
    limit, most = max(1, total // new_shards // fine), max(1, total // new_shards // whole)

    heavy = groups.where(F.col("bytes") > limit).orderBy(F.desc("bytes"), "text_hash").collect()
    split = [(r["text_hash"], -(-int(r["bytes"]) // most)) for r in heavy if r["bytes"] > most]
    dealt = rows.join(F.broadcast(spark.createDataFrame(split, "text_hash long, parts int")), "text_hash", "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    homes = {r["text_hash"]: r["home"] for r in heavy}
    parts = [(r["text_hash"], 0, int(r["bytes"]), r["home"]) for r in heavy if r["bytes"] <= most]
    if split:
        cut = dealt.where(F.col("text_hash").isin([h for h, _ in split])).groupBy("text_hash", "part").agg(F.sum("size").alias("bytes"))
        parts += [(r["text_hash"], r["part"], int(r["bytes"]), homes[r["text_hash"]]) for r in cut.orderBy("text_hash", "part").collect()]
    shards = place_heavy([(p[2], p[3]) for p in parts], capacity)
    loads = [0] * new_shards
    for p, shard in zip(parts, shards):
        loads[shard] += p[2]

    light = groups.where(F.col("bytes") <= limit)
    sizes = light.groupBy("home", "block").agg(F.sum("bytes").alias("bytes")).orderBy("home", "block").collect()
    n_old = max([new_shards, *(r["home"] + 1 for r in sizes)])
    supply, begins = [0] * n_old, []
    for r in sizes:
        begins.append((r["home"], r["block"], supply[r["home"]]))
        supply[r["home"]] += int(r["bytes"])
    flow = minimum_cost_flow(supply, fill(loads, sum(supply)))
    segments = []
    for i in range(n_old):
        start = 0
        # What stays lies first, so that a file keeps its front.
        for j in sorted(range(new_shards), key=lambda j, i=i: (j != i, j)):
            if flow[i][j]:
                segments.append((i, start, start + flow[i][j], j))
                start += flow[i][j]
    begins = F.broadcast(spark.createDataFrame(begins, "home int, block int, begin long"))
    segments = F.broadcast(spark.createDataFrame(segments, "home int, low long, high long, shard int"))
    line = Window.partitionBy("home", "block").orderBy("text_hash").rowsBetween(Window.unboundedPreceding, -1)
    lined = light.withColumn("before", F.sum("bytes").over(line)).join(begins, ["home", "block"]).withColumn("at", F.col("begin") + F.coalesce("before", F.lit(0)))
    of_light = lined.join(segments, "home").where("at >= low and at < high").select("text_hash", "shard")

    of_parts = F.broadcast(spark.createDataFrame([(p[0], p[1], s) for p, s in zip(parts, shards)], "text_hash long, part int, heavy_shard int"))
    dealt = dealt.join(of_parts, ["text_hash", "part"], "left")
    columns = ["doc_id", "size", "text_crc32", "old", "block", "shard"]
    of_rows = dealt.where("heavy_shard is not null")
    # Rows of a heavy group are dealt over all blocks, as none of them could take it.
    of_rows = of_rows.select("doc_id", "size", "text_crc32", "old", F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)).cast("int").alias("block"), F.col("heavy_shard").alias("shard"))
    others = dealt.where("heavy_shard is null").withColumn("block", F.pmod(F.xxhash64("text_hash"), F.lit(blocks)).cast("int")).join(of_light, "text_hash")
    placed = materialize(others.select(*columns).unionByName(of_rows.select(*columns)), "shard-placed")

    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).orderBy("shard", "block").collect()
    offsets, seen = [], dict.fromkeys(range(new_shards), 0)
    for r in counts:
        offsets.append((r["shard"], r["block"], seen[r["shard"]]))
        seen[r["shard"]] += r["n"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "shard int, block int, first long"))
    inside = Window.partitionBy("shard", "block").orderBy("text_crc32", "size", "doc_id", "old")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "old", "shard", (F.col("first") + F.col("place")).alias("slot"))
    )


def affected(plan: DataFrame) -> list[int]:
    """Shards whose files differ from before: those that rows leave or enter."""
    moved = plan.where("old <> shard").select(F.explode(F.array("old", "shard")).alias("s")).distinct()
    return sorted(r["s"] for r in moved.collect())


def rewrite(docs: DataFrame, plan: DataFrame, folder: str, *, id_col: str = "doc_id", file_bytes: int = FILE_BYTES) -> list[int]:
    """Write the shards that changed to ``folder``/shard=N, in slot order, and
    leave the files of all others alone; returns the shards written.

    ``id_col`` must tell rows apart.  A shard is written as runs of slots of
    about ``file_bytes``, by as many tasks.  Only the named partitions are
    replaced; columns ``shard`` and ``slot`` of ``docs`` give way to the plan's.
    """
    shards = affected(plan)
    moved = plan.where(F.col("shard").isin(shards))
    size = moved.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] if "size" in plan.columns else 0
    rows = docs.drop("shard", "slot").join(moved.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    tasks = max(1, len(shards), -(-int(size) // file_bytes))
    spread = rows.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    return shards
