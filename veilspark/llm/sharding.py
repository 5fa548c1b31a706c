"""Hilbert-curve sharding: quantise metadata dimensions, order rows along the curve, cut the order into runs.

Only DataFrame functions are used.  Neighbouring rows on the curve agree in several dimensions at once, so the
minima and maxima of each written file prune on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, fresh

#: Pieces into which rows of one curve cell are dealt by a hash of their order columns; a cell that holds a third of
#: all rows is still sorted by this many tasks.
SUB_BUCKETS = 1024


def log2_cell(value: Column, bits: int) -> Column:
    """A count or size by its binary magnitude; null and negative values go to cell 0."""
    top = (1 << bits) - 1
    v = F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log2(v + 1)), F.lit(top)).cast("int")


def hash_cell(value: Column, bits: int) -> Column:
    """A label by hash: equal labels share a cell.  Null goes to cell 0, labels to the others."""
    top = (1 << bits) - 1
    return F.when(value.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(value), F.lit(top)) + 1).cast("int")


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Position on the Hilbert curve through a grid of 2**bits cells a side (at most 62 bits in all).

    The coordinates are folded by exchanges and inversions from the top bit down, then Gray-coded and interleaved.
    Loops run inside `aggregate`, so the expression stays small for any number of bits.
    """
    n = len(cells)
    if n < 2 or n * bits > 62:
        raise ValueError("two dimensions or more, and 62 bits in all, at most")
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    start = F.array(*[c.cast("int") for c in cells])

    def fold(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, i)).bitwiseAND(low)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(F.get(x, i).bitwiseAND(q) != 0, inverted).when(i == 0, x).otherwise(swapped)

    folded = F.aggregate(start, start, lambda x, _: x) if bits < 2 else F.aggregate(steps, start, fold)

    def finish(x: Column) -> Column:
        gray = [F.get(x, F.lit(0))]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(F.get(x, F.lit(i))))
        return F.array(*gray)

    def untwist(g: Column) -> Column:
        last = F.get(g, F.lit(n - 1))
        bits_down = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
        t = F.aggregate(bits_down, F.lit(0), lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return F.transform(g, lambda v: v.bitwiseXOR(t))

    def interleave(g: Column) -> Column:
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        bit = lambda s: F.call_function("shiftright", F.get(g, s["i"]), s["b"]).bitwiseAND(F.lit(1)).cast("long")
        return F.aggregate(order, F.lit(0).cast("long"), lambda acc, s: acc * 2 + bit(s))

    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  binds a value to a name
    return once(folded, lambda x: once(finish(x), lambda g: once(untwist(g), interleave)))


def hilbert_shards(df: DataFrame, cells: Sequence[Column], *, bits: int, order: Sequence[str], n_shards: int, shard: str = "shard", slot: str = "slot", position: str = "curve_index") -> DataFrame:
    """df with three columns more: shard (int, 0 to n_shards-1), slot (long, gapless from 0 in each shard) and the
    curve index.  Law `rows`: shards are consecutive runs of the curve and their counts differ by one at most.

    cells: the quantised dimensions (log2_cell, hash_cell).  order: columns that settle the order inside a curve cell;
    rows that are equal in all of them may stand in either order, which changes no shard's size.  Nulls sort first.
    An empty table gives an empty table; a name that df already has is refused.  The number of rows is counted by cell and hash piece (pre-aggregated), running totals over at most 2**(bits*dimensions)
    cells give each piece its first position, and each piece numbers its own rows.
    """
    clash = {c.lower() for c in df.columns} & {shard.lower(), slot.lower(), position.lower()}
    if clash:
        raise ValueError(f"the table already has {sorted(clash)}")
    sub, n, first, total = fresh(df, "sub_", "n_", "first_", "total_")
    keyed = df.withColumn(position, hilbert_index(cells, bits)).withColumn(sub, F.pmod(F.xxhash64(*[col(c) for c in order]), F.lit(SUB_BUCKETS)).cast("int"))
    pieces = keyed.groupBy(position, sub).agg(F.count(F.lit(1)).alias(n))
    by_cell = pieces.groupBy(position).agg(F.sum(n).alias(n))
    before = Window.orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(position).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = by_cell.select(position, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first), F.sum(n).over(everything).alias(total))
    inside = Window.partitionBy(position).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.join(starts, position).select(position, sub, (col(first) + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(first), total)
    rank = F.row_number().over(Window.partitionBy(position, sub).orderBy(*[col(c) for c in order])) - 1 + col(first)
    at, each, longer = fresh(df, "rank_", "each_", "longer_")
    ranked = keyed.join(offsets, [position, sub]).withColumn(at, rank)
    ranked = ranked.withColumn(each, F.expr(f"{total} div {n_shards}")).withColumn(longer, F.expr(f"{total} % {n_shards}"))
    in_long = col(at) < col(longer) * (col(each) + 1)
    k = F.when(in_long, F.expr(f"{at} div ({each} + 1)")).otherwise(col(longer) + F.expr(f"({at} - {longer} * ({each} + 1)) div greatest({each}, 1)"))
    start = k * col(each) + F.least(k, col(longer))
    return ranked.select(*[col(c) for c in df.columns], k.cast("int").alias(shard), (col(at) - start).cast("long").alias(slot), position)


def write_shards(sharded: DataFrame, path: str, *, shard: str = "shard", slot: str = "slot") -> None:
    """One folder a shard, its rows in slot order and in files of at most a million rows.

    Null and repeated rows are written as they are; an empty table gives a folder without rows, and a folder that is
    there is an error.  A shard may be written by several tasks, which divide its slots by range.
    """
    (sharded.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).option("maxRecordsPerFile", 1_000_000).mode("errorifexists").parquet(path))
