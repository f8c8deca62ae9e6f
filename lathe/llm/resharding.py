"""Minimum-cost-flow resharding.

From the bytes of the old shards and the capacities of the new ones, the driver solves the
transport problem that moves the fewest bytes (a byte that stays in the shard of the same number
costs nothing). Within an old shard the rows lie on a line: blocks in order of their number, rows
in order of their id within a block. Each flow takes the next stretch of that line, so whole blocks
move together and only blocks at the ends of stretches are split; a row belongs to the stretch that
holds its middle byte. Rows that are large against a shard are placed first, in classes of size.
Each class takes its part, in proportion, of one flow over all bytes that aren't placed yet, so the
first flow, over the sums of the shards, sets what moves; those after it make up for what whole rows
left uneven, so the shards end even to within a row of the smallest class that has bytes enough.

Only the sums of the old shards (a number fixed by the layout) reach the driver. Blocks are about
sqrt(rows) / 2 rows long, so neither the table of blocks nor a block grows as the rows do; a source
or shard that holds a third of all rows has a third of the blocks. Texts are not shuffled unless
they are asked for (`carry`).

Rows move as bytes, not in groups: rows of equal texts may lie in several shards. A group may hold a
third of all rows, so no layout of near equal sizes could keep groups whole.

Defined results: a null text counts as empty; null ids are one more id; rows with equal ids are
ordered by crc and size, and equal rows may take each other's place; an empty table gives an empty
result; columns not asked for are left out.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.session import ensure_checkpoint_dir

#: A row is in the first class if larger than a shard's share over the first number, and so on.
SIZE_CLASSES = (8, 32, 128, 512)


def capacities(total: int, shards: int) -> list[int]:
    """`total` in `shards` whole parts that differ by one at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def minimum_cost_moves(old: dict[int, int], new: list[int], cost=None) -> dict[int, list[tuple[int, int]]]:
    """For each old shard, the bytes it gives to new ones: [(new shard, bytes)], at least total cost.

    Successive shortest augmenting paths with potentials. `cost(i, j)` is that of a byte; by default
    0 where i == j, else 1. The sums of `old` and `new` must be equal.
    """
    if sum(old.values()) != sum(new):
        raise ValueError(f"old shards hold {sum(old.values())} bytes, new ones {sum(new)}")
    cost = cost or (lambda i, j: 0 if i == j else 1)
    left, ids = dict(old), sorted(old)
    need = list(new)
    node = {("o", i): k for k, i in enumerate(ids)} | {("n", j): len(ids) + j for j in range(len(new))}
    names = list(node)
    price = [0] * len(names)
    flow: dict[tuple[int, int], int] = {}
    costs = {(i, j): cost(i, j) for i in ids for j in range(len(new))}
    if any(c < 0 for c in costs.values()):
        raise ValueError("costs must not be negative")
    while any(left.values()):
        far = [math.inf] * len(names)
        came: list[int | None] = [None] * len(names)
        queue = []
        for i in ids:
            if left[i]:
                far[node["o", i]] = 0
                heapq.heappush(queue, (0, node["o", i]))
        done = set()
        while queue:
            d, u = heapq.heappop(queue)
            if u in done:
                continue
            done.add(u)
            side, i = names[u]
            if side == "o":
                edges = [(node["n", j], costs[i, j]) for j in range(len(new))]
            else:
                edges = [(node["o", k], -costs[k, i]) for k in ids if flow.get((k, i))]
            for v, c in edges:
                if (e := d + c + price[u] - price[v]) < far[v]:
                    far[v], came[v] = e, u
                    heapq.heappush(queue, (e, v))
        end = min((j for j in range(len(new)) if need[j]), key=lambda j: far[node["n", j]] + price[node["n", j]])
        for k in range(len(names)):
            if far[k] < math.inf:
                price[k] += far[k]
        path, v = [], node["n", end]
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        first = names[v][1]
        amount = min([left[first], need[end], *(flow[names[v][1], names[u][1]] for u, v in path if names[u][0] == "n")])
        for u, v in path:
            if names[u][0] == "o":
                flow[names[u][1], names[v][1]] = flow.get((names[u][1], names[v][1]), 0) + amount
            else:
                flow[names[v][1], names[u][1]] -= amount
        left[first] -= amount
        need[end] -= amount
    out = {i: [] for i in ids}
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][1] != x[0][0], x[0][1])):
        if amount:
            out[i].append((j, amount))
    return out


def affected_shards(moves: dict[int, list[tuple[int, int]]]) -> set[int]:
    """New shards that gain or lose a byte; the files of all others stay as they are."""
    out = set()
    for i, to in moves.items():
        for j, _ in to:
            if i != j:
                out |= {i, j}
    return out


def level(filled: list[int], amount: int) -> list[int]:
    """How `amount` goes to shards that hold `filled` bytes so that they end as level as can be."""
    order = sorted(range(len(filled)), key=lambda j: (filled[j], j))
    left, height, out = amount, 0, [0] * len(filled)
    for n, j in enumerate(order, 1):  # the n lowest shards rise to the next one's height
        height = filled[j]
        step = (filled[order[n]] - height) * n if n < len(order) else left
        if step >= left:
            break
        left -= step
    lowest = order[:n]
    for k, j in enumerate(lowest):
        out[j] = height - filled[j] + left // n + (k < left % n)
    return out


def part_of(to: list[tuple[int, int]], amount: int) -> list[tuple[int, int]]:
    """`amount` bytes in the proportions of a shard's flow."""
    every, at, done, out = sum(b for _, b in to), 0, 0, []
    for j, b in to:
        at += b
        end = amount * at // every
        if end > done:
            out.append((j, end - done))
        done = end
    return out


def _destination(moves: dict[int, list[tuple[int, int]]], line: Column, middle: Column) -> Column:
    by_line = None
    for i, to in moves.items():
        at, inner = 0, None
        for j, amount in to[:-1]:
            at += amount
            inner = F.when(middle < 2 * at, j) if inner is None else inner.when(middle < 2 * at, j)
        last = F.lit(to[-1][0] if to else i)
        value = last if inner is None else inner.otherwise(last)
        by_line = F.when(line == i, value) if by_line is None else by_line.when(line == i, value)
    return (by_line if by_line is not None else F.lit(0)).cast("int")


def _placed(rows: DataFrame, moves: dict[int, list[tuple[int, int]]], counts: dict[int, int], long: int) -> DataFrame:
    """Rows of one size class with _block, _before and _shard."""
    blocks_of = None
    for i, n in counts.items():
        blocks_of = F.when(F.col("_old") == i, -(-n // long)) if blocks_of is None else blocks_of.when(F.col("_old") == i, -(-n // long))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_crc"), blocks_of.cast("long")))
    blocks = rows.groupBy("_old", "_block").agg(F.sum("_size").alias("_bytes"))
    starts = blocks.select("_old", "_block", (F.sum("_bytes").over(Window.partitionBy("_old").orderBy("_block")) - F.col("_bytes")).alias("_start"))
    order = Window.partitionBy("_old", "_block").orderBy("_id", "_crc", "_size")
    before = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    placed = rows.withColumn("_before", before).join(starts, ["_old", "_block"])
    return placed.withColumn("_shard", _destination(moves, F.col("_old"), 2 * (F.col("_start") + F.col("_before")) + F.col("_size"))).drop("_start").checkpoint()


def reshard(docs: DataFrame, old_shard: Column, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: tuple[str, ...] = (), cost=None) -> tuple[DataFrame, dict[int, list[tuple[int, int]]]]:
    """(placement, moves): id, size, text_crc32, old_shard, shard, slot and the carried columns.

    `old_shard` is a column of whole numbers from 0. A row's size is its text's UTF-8 bytes plus
    `overhead`; slots are gapless from 0 in each new shard.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + overhead).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        old_shard.cast("int").alias("_old"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    ).checkpoint()
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    ends = [max(1, total["b"] // shards // d) for d in SIZE_CLASSES]
    rows = rows.withColumn("_class", sum(((F.col("_size") <= e).cast("int") for e in ends), F.lit(0)))
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("_class", "_old").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect():
        sums.setdefault(r["_class"], {})[r["_old"]] = (r["n"], r["b"])
    long = max(1, math.isqrt(total["n"]) // 2)
    filled, moves, parts = [0] * shards, {}, []
    for c in sorted(sums):  # large rows first; the smaller ones make up for what those leave uneven
        left: dict[int, int] = {}
        for k in sums:
            for i, (_, b) in sums[k].items() if k >= c else ():
                left[i] = left.get(i, 0) + b
        whole = minimum_cost_moves(left, level(filled, sum(left.values())), cost)
        flow = {i: part_of(whole[i], b) for i, (_, b) in sums[c].items()}
        parts.append(_placed(rows.where(F.col("_class") == c), flow, {i: n for i, (n, _) in sums[c].items()}, long))
        for r in parts[-1].groupBy("_shard").agg(F.sum("_size").alias("b")).collect():
            filled[r["_shard"]] += r["b"]
        for i, to in flow.items():
            mine = moves.setdefault(i, {})
            for j, amount in to:
                mine[j] = mine.get(j, 0) + amount
    placed = reduce(DataFrame.unionByName, parts) if parts else rows.withColumns({"_block": F.lit(0).cast("long"), "_before": F.lit(0).cast("long"), "_shard": F.lit(0)})

    held = placed.groupBy("_shard", "_class", "_old", "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = held.select("_shard", "_class", "_old", "_block", (F.sum("_n").over(Window.partitionBy("_shard").orderBy("_class", "_old", "_block")) - F.col("_n")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_class", "_old", "_block", "_shard").orderBy("_before", "_id", "_crc")) - 1
    out = placed.withColumn("_place", place).join(offsets, ["_class", "_old", "_block", "_shard"])
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_old").alias("old_shard"),
        F.col("_shard").alias("shard"), (F.col("_offset") + F.col("_place")).cast("long").alias("slot"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry if c != id_col],
    ), {i: sorted(to.items()) for i, to in moves.items()}


def rewrite_files(path: str, spark: SparkSession, out: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> set[int]:
    """Rewrite a table laid out as `path`/shard=K/ into `shards` shards under `out`; the shards whose rows change.

    Those are dealt to tasks by ranges of their slots, so a large shard has several files. The rows of
    all others are copied as they are, without a shuffle, so `out` is the whole table.
    """
    old = spark.read.parquet(path)
    columns = [c for c in old.columns if c != "shard"]
    placed, moves = reshard(old, F.col("shard"), shards, id_col, text_col, carry=tuple(columns))
    changed = affected_shards(moves)
    moved = F.col("shard").isin(sorted(changed))
    rows = placed.where(moved).select(*columns, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
    rows.write.mode("overwrite").partitionBy("shard").parquet(out)
    old.where(~moved).select(*columns, "shard").write.mode("append").partitionBy("shard").parquet(out)
    return changed
