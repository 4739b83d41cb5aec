"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to a few bits each; the point's place on the Hilbert curve through that grid is
the sort key, and shards are runs of equal row counts along the curve. Rows of a shard are close in every dimension,
so the files' minima and maxima prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, saved


def _tables(d: int) -> tuple[list[int], list[int]]:
    """For each (state, cell): the cell's order on the curve, and the state inside it.

    A state is an entry corner and an axis. Inside a cell the curve is the same one, reflected and rotated so that it
    enters where the cell before it was left; both follow from the Gray code of the cell's order.
    """
    n = 1 << d
    turn = lambda x, k: ((x << k % d) | (x >> (d - k % d) % d if k % d else 0)) & (n - 1)
    gray = [i ^ i >> 1 for i in range(n)]
    order_of = {g: i for i, g in enumerate(gray)}
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, n)]
    ones = lambda i: (~i & i + 1).bit_length() - 1
    axis = [0 if i == 0 else ones(i - 1) % d if i % 2 == 0 else ones(i) % d for i in range(n)]
    order, state = [], []
    for s in range(d * n):
        k, e = divmod(s, n)
        for cell in range(n):
            w = order_of[turn(cell ^ e, d - (k + 1) % d)]
            order.append(w)
            state.append((k + axis[w] + 1) % d * n + (e ^ turn(entry[w], k + 1)))
    return order, state


def curve_index(dims: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point with integer coordinates of so many bits each."""
    d, n = len(dims), 1 << len(dims)
    order, state = _tables(d)
    orders, states = F.array(*map(F.lit, order)), F.array(*map(F.lit, state))

    def step(acc: Column, k: Column) -> Column:
        cell = F.lit(0)
        for j, c in enumerate(dims):
            cell = cell + F.call_function("shiftright", c.cast("int"), k).bitwiseAND(F.lit(1)) * F.lit(1 << j)
        at = acc["s"] * n + cell + 1
        return F.struct(F.element_at(states, at).alias("s"), (acc["h"] * n + F.element_at(orders, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)]), start, step, lambda acc: acc["h"])


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``by``, without bringing the rows to one task.

    Rows are dealt by range and sorted; a row's place is its place in its partition plus the rows of the partitions
    before it. The sorted rows are saved first, so that both readings see the same ones.
    """
    spark = df.sparkSession
    sort = [F.col(c).asc_nulls_first() for c in by]
    laid = saved(df.repartitionByRange(max(1, partitions(spark)), *sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sums = laid.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return laid.withColumn("__part", part).join(before, "__part").withColumn(name, place + F.col("__before")).drop("__part", "__at", "__before")


def quantised(df: DataFrame, column: str, bits: int, name: str) -> DataFrame:
    """Adds a column's cell of 2**bits: numbers by their logarithm, anything else by its rank among the distinct values; null: 0."""
    top = (1 << bits) - 1
    if dict(df.dtypes)[column] in ("bigint", "int", "double", "float", "smallint", "tinyint"):
        cell = F.floor(F.log2(F.greatest(F.col(column).cast("double"), F.lit(0.0)) + 1) * (top / 32)).cast("int")
        return df.withColumn(name, F.coalesce(F.least(cell, F.lit(top)), F.lit(0)))
    values = ranked(df.select(F.col(column).cast("string").alias("__v")).where("__v is not null").distinct(), ["__v"], "__r")
    total = values.agg(F.count(F.lit(1)).alias("__all"))
    cell = F.least(F.lit(top), 1 + F.floor(F.col("__r") * top / F.col("__all"))).cast("int")
    cells = values.join(F.broadcast(total)).select("__v", cell.alias(name))
    return df.join(cells, F.col(column).cast("string") == F.col("__v"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("__v")


def shard(df: DataFrame, dims: list[str], shards: int, bits: int = 8, tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``df`` with hilbert (long), shard (int) and slot (long, from 0 without gaps in each shard).

    Shards are runs along the curve whose row counts differ by one at most, whatever the data: rows that share a place
    on the curve, copies too, are parted by ``tie``. A null has the lowest cell. An empty table gives no rows.
    """
    names = [f"__q{i}" for i in range(len(dims))]
    for c, name in zip(dims, names, strict=True):
        df = quantised(df, c, bits, name)
    df = ranked(df.withColumn("hilbert", curve_index([F.col(c) for c in names], bits)).drop(*names), ["hilbert", *tie], "__place")
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    df = df.join(F.broadcast(total)).withColumn("shard", F.expr(f"cast((__place * {shards}) div __n as int)"))
    return df.withColumn("slot", F.expr(f"__place - (shard * __n + {shards - 1}) div {shards}")).drop("__place", "__n")
