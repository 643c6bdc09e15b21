"""Resharding by minimum-cost flow.

Old shard sizes and new capacities give a flow problem of a few dozen nodes: a byte that
stays costs 0, a byte that changes its shard costs its price. Its solution says how many
bytes each old shard sends where; documents are then taken in blocks (hash buckets within
size classes), so that the driver sees shard totals only and every running sum is over
one bounded block. A second, small round moves short documents to even out what whole
documents left over.

Edges: null text has size 8 and CRC 0; equal texts are separate documents; repeated ids
are placed by (doc_id, text CRC); null ids count as id text ''; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulecast.settle import broadcast_if_small

from .common import stored

OVERHEAD = 8  # bytes of a document besides its text
BUCKETS = 1024  # hash buckets of a block level


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest shipment {(source, sink): amount} of all supplies within the capacities,
    by successive shortest paths (Dijkstra with potentials). ``cost(i, j)`` >= 0."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    total = sum(supply)
    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, total, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * len(graph)
    left = total
    while left:
        far: list = [None] * len(graph)
        via: list = [None] * len(graph)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (far[b] is None or d + price + potential[a] - potential[b] < far[b]):
                    far[b] = d + price + potential[a] - potential[b]
                    via[b] = (a, k)
                    heapq.heappush(heap, (far[b], b))
        if far[sink] is None:
            raise ValueError("capacities are smaller than the data")
        potential = [p + (far[v] if far[v] is not None else 0) for v, p in enumerate(potential)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = via[at][0]
        amount = min([left, *(graph[a][k][1] for a, k in path)])
        for a, k in path:
            graph[a][k][1] -= amount
            graph[graph[a][k][0]][graph[a][k][3]][1] += amount
        left -= amount
    return {(i, b - n): graph[b][back][1] for i in range(n) for b, _, _, back in graph[i] if n <= b < n + m and graph[b][back][1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(sizes: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Block transfers (old shard, from byte, to byte, new shard) of the cheapest flow:
    old shard i is read as a line of sizes[i] bytes whose first part stays."""
    old = sorted(sizes)
    flow = min_cost_flow([sizes[i] for i in old], capacity, lambda i, j: int(old[i] != j))
    out = []
    for k, i in enumerate(old):
        at = flow.get((k, i), 0)
        for j in range(len(capacity)):
            if j != i and (amount := flow.get((k, j), 0)):
                out.append((i, at, at + amount, j))
                at += amount
    return out


def _move(placed: DataFrame, capacity: list[int], short_first: bool) -> DataFrame:
    """``placed`` (doc_id, size, text_crc32, old, shard) with ``shard`` changed by one flow.
    ``short_first``: the longest documents stay and the shortest move."""
    sizes = {r["shard"]: int(r["bytes"]) for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    plan = transfers(sizes, capacity)
    if not plan:
        return placed
    size_class = F.floor(F.log2(F.col("size").cast("double")) * 16).cast("int")
    rows = (placed.withColumn("_class", -size_class if short_first else F.lit(0))
            .withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int")))
    # Where each block starts: at most BUCKETS x size classes rows a shard.
    blocks = rows.groupBy("shard", "_class", "_bucket").agg(F.sum("size").alias("_bytes"))
    line = Window.partitionBy("shard").orderBy("_class", "_bucket")
    blocks = blocks.withColumn("_start", F.sum("_bytes").over(line) - F.col("_bytes"))
    cut = [i for i in {p[0] for p in plan}]
    first = {i: min(p[1] for p in plan if p[0] == i) for i in cut}
    begins = F.create_map(*[F.lit(x) for i in cut for x in (i, first[i])])
    moving = blocks.where(F.col("_start") + F.col("_bytes") > begins[F.col("shard")])
    inside = Window.partitionBy("shard", "_class", "_bucket").orderBy("size", "doc_id", "text_crc32", "_row")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    moving = stored(moving.select("shard", "_class", "_bucket", "_start"), "moving")
    rows = rows.join(broadcast_if_small(moving, moving.count()), ["shard", "_class", "_bucket"], "left")
    rows = stored(rows, "blocks")
    middle = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    taken = rows.where("_start IS NOT NULL").withColumn("_middle", middle)
    target = None
    for i, a, b, j in plan:
        here = (F.col("shard") == i) & (F.col("_middle") >= a) & (F.col("_middle") < b)
        target = F.when(here, j) if target is None else target.when(here, j)
    taken = taken.withColumn("shard", F.coalesce(target, F.col("shard"))).drop("_middle")
    return rows.where("_start IS NULL").unionByName(taken).select(*placed.columns)


def reshard(docs: DataFrame, shards: int, old_shard) -> DataFrame:
    """Place every document of ``docs`` (doc_id, text, ...) into ``shards`` shards of near
    equal bytes, from where the Column ``old_shard`` has it now, moving few bytes.

    Returns doc_id, size, text_crc32, old_shard, shard, slot (0, 1, ... in each shard).
    """
    placed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
    ).withColumn("shard", F.col("old_shard")).withColumn("_row", F.monotonically_increasing_id())
    placed = stored(placed, "placed")
    total = placed.agg(F.sum("size")).head()[0] or 0
    capacity = equal_capacities(int(total), shards)
    for short_first in (False, True, True):
        placed = stored(_move(placed, capacity, short_first), "placed")
    return number_slots(placed).drop("_row")


def number_slots(placed: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: counts of hash buckets give each bucket its
    first slot, and rows are numbered within their bucket."""
    n = placed.count()
    buckets = max(1, n // 2000)
    rows = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "_row"), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    line = Window.partitionBy("shard").orderBy("_bucket")
    counts = counts.withColumn("_first", F.sum("_n").over(line) - F.col("_n")).drop("_n")
    order = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "_row")
    rows = rows.withColumn("_at", F.row_number().over(order) - 1)
    return rows.join(counts, ["shard", "_bucket"]).withColumn(
        "slot", (F.col("_first") + F.col("_at")).cast("bigint")).drop("_bucket", "_at", "_first")


def rewrite_shards(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the shards that gain or lose documents below ``path`` (shard=<n>/, or _shard=<n>/
    beside a column so named), each split over several tasks; returns their numbers. The folders of shards that lose all their documents
    go once the new files are committed; the files of other shards stay as they are."""
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    moved = placed.where("shard <> old_shard")
    touched = sorted({r[0] for r in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect()})
    if touched:
        # Rows of equal id and text are told apart by their number, in both tables. A row goes
        # along as one column, so that no name of it meets those used here.
        crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("crc")
        copies = Window.partitionBy("id", "crc").orderBy("crc")
        id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
        row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
        rows = docs.select(id_text, crc, row).withColumn("copy", F.row_number().over(copies))
        where = placed.select(id_text, F.col("text_crc32").alias("crc"), "shard").withColumn(
            "copy", F.row_number().over(copies.orderBy("shard"))).where(F.col("shard").isin(touched))
        salt = F.pmod(F.xxhash64("id"), F.lit(8))
        laid = rows.join(where, ["id", "crc", "copy"]).repartition("shard", salt)
        laid.select("row.*", F.col("shard").alias(name)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
        left = {r[0] for r in placed.where(F.col("shard").isin(touched)).select("shard").distinct().collect()}
        spark = docs.sparkSession
        for n in sorted({*touched} - left):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}={n}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
