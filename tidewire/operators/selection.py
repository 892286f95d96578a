"""Selections that depend on what was taken before: quotas, diversity and packing into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.graphs import shared_folder


def quota(df: DataFrame, groups: dict[str, int], order: list[Column]) -> DataFrame:
    """Rows that a walk in `order` keeps if any of their groups (column: quota) has room; every kept row takes room in all its groups.

    A group has room for a row just if fewer than its quota of rows came before it: as long as it has room it takes all that come.
    So the walk equals a rank per group, and nothing is walked. A null group counts for nothing.
    """
    ranks = [(F.row_number().over(Window.partitionBy(g).orderBy(*order)) <= q) & F.col(g).isNotNull() for g, q in groups.items()]
    out = df.select("*", *(r.alias(f"_q{i}") for i, r in enumerate(ranks)))
    kept = F.lit(False)
    for i in range(len(ranks)):
        kept = kept | F.col(f"_q{i}")
    return out.filter(kept).select(*df.columns)


def diverse(df: DataFrame, by: str, score: list[Column], item: str, words: str, most: int, pool: int = 200, shared: int = 3, overlap: float = 0.5) -> DataFrame:
    """by, rank and item of the first `most` rows of each group, in order, each unlike all taken before.

    Two are alike if they share `shared` words and that is `overlap` of the shorter one. A round looks at `pool` ranked rows of a
    group. Where an edition is not full then, the next round looks at the rows left that are unlike all taken, the first of which
    is taken, so there are at most `most` rounds. The fold runs within the JVM.
    """
    shared_folder(df.sparkSession)

    def alike(a: Column, b: Column) -> Column:
        n = F.size(F.array_intersect(a["w"], b["w"]))
        return (n >= shared) & (n >= overlap * F.least(F.size(F.array_distinct(a["w"])), F.size(F.array_distinct(b["w"]))))

    take = lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda t: alike(t, x)), acc).otherwise(F.concat(acc, F.array(x)))

    def walk(left: DataFrame, start: Column) -> DataFrame:
        top = left.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*score))).filter(F.col("_rn") <= pool)
        rows = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(item).alias("id"), F.col(words).alias("w")))).alias("rows"), F.first("_taken").alias("_taken"))
        return rows.select(by, F.aggregate("rows", start, take).alias("_taken")).checkpoint()

    new = taken = walk(df.withColumn("_taken", F.lit(None)), F.slice("rows", 1, 0))
    while not (short := new.filter(F.size("_taken") < most).withColumnRenamed(by, "_by")).isEmpty():
        x = F.struct(F.col(words).alias("w"))
        rest = df.join(short, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").filter(~F.coalesce(F.exists("_taken", lambda t: alike(t, x)), F.lit(False)))
        # a row of few words is unlike even itself: those taken are the first of their kind
        times = F.size(F.filter("_taken", lambda t: t["id"].eqNullSafe(F.col(item)) & t["w"].eqNullSafe(F.col(words))))
        nth = F.row_number().over(Window.partitionBy(by, item, words).orderBy(*score))
        again = rest.filter(times > 0).withColumn("_nth", nth).filter(F.col("_nth") > times).drop("_nth")
        new = walk(rest.filter(times == 0).unionByName(again), F.col("_taken"))
        done = new.select(F.col(by).alias("_by"))
        taken = taken.join(done, F.col(by).eqNullSafe(F.col("_by")), "left_anti").unionByName(new).checkpoint()
    out = taken.select(by, F.posexplode("_taken").alias("rank", "x"))
    return out.select(by, (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(item))


#: Rows of a stretch that one call packs.
STRETCH = 4096


def _step(used: int | None, n: int, size: int | None, limit: int, most: int) -> tuple[bool, int | None, int]:
    """Whether a row begins a message, and the size and rows of its message then. A size that is null makes the message's unknown."""
    new = n > 0 and (n >= most or (used is not None and size is not None and used + size > limit))
    return (True, size, 1) if new else (False, None if used is None or size is None else used + size, n + 1)


def _ways(sizes: list[int | None], limit: int, most: int) -> list[tuple[int, int | None, int]]:
    """For each of the first `most` rows: if a message begins there, the messages that begin after it, and size and rows of the last.

    Wherever a message begins, its successor begins at most `most` rows later, so all ways are followed from the last row to the first.
    """
    ways: list[tuple[int, int | None, int]] = [(0, 0, 0)] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        used, n = 0, 0
        for j in range(i, len(sizes)):
            new, used, n = _step(used, n, sizes[j], limit, most)
            if new:
                more, *end = ways[j]
                ways[i] = (more + 1, *end)
                break
        else:
            ways[i] = (0, used, n)
    return ways[:most]


def _entered(stretches: list, limit: int, most: int) -> list[tuple[int, int, int | None, int]]:
    """(stretch, message, size, rows) of the message that is open where each stretch of a group begins."""
    m, used, n, out = -1, 0, most, []  # as if a full message stood before the first row
    for s in stretches:
        out.append((s["stretch"], m, used, n))
        for size, way in zip(s["head"], s["ways"], strict=True):
            new, used, n = _step(used, n, size, limit, most)
            if new:  # from here on the way is known
                m, used, n = m + 1 + way["more"], way["used"], way["n"]
                break
    return out


def _messages(sizes: list[int | None], m: int, used: int | None, n: int, limit: int, most: int) -> list[int]:
    out = []
    for size in sizes:
        new, used, n = _step(used, n, size, limit, most)
        m += new
        out.append(m)
    return out


def pack(df: DataFrame, by: str, order: list[str], size: str, limit: int, most: int) -> DataFrame:
    """Adds `message`, the number of the message that a row goes into: a new one begins where the row would pass `limit` in size or
    `most` rows. A row over the limit gets a message of its own.

    Rows are dealt out by ranges, so a group of any size spreads over tasks, in stretches of at most STRETCH rows. A stretch tells how it
    ends for each of the rows that its first message may begin at, `most` at most; these are chained by group, and then every
    stretch is packed from where it is entered. Time grows with the rows.
    """
    shared_folder(df.sparkSession)
    most = max(most, 1)  # a row alone is a message
    item = F.struct(*order, F.col(size).cast("long").alias("_size"))
    rows = df.select(F.col(by).alias("_by"), item.alias("_row")).repartitionByRange("_by", "_row").sortWithinPartitions("_by", "_row")
    stretch = F.floor(F.monotonically_increasing_id() / STRETCH).alias("_stretch")
    parts = rows.select("_by", "_row", stretch).groupBy("_by", "_stretch").agg(F.array_sort(F.collect_list("_row")).alias("rows")).checkpoint()
    sizes = F.transform("rows", lambda x: x["_size"])
    state = "used: bigint, n: int"
    ways = F.udf(lambda x: _ways(x, limit, most), f"array<struct<more: int, {state}>>")
    entered = F.udf(lambda x: _entered(x, limit, most), f"array<struct<stretch: bigint, m: int, {state}>>")
    messages = F.udf(lambda x, s: _messages(x, s["m"], s["used"], s["n"], limit, most), "array<int>")
    ends = parts.select("_by", F.struct(F.col("_stretch").alias("stretch"), F.slice(sizes, 1, most).alias("head"), ways(sizes).alias("ways")).alias("s"))
    chains = ends.groupBy("_by").agg(F.array_sort(F.collect_list("s")).alias("s"))
    begins = chains.select(F.col("_by").alias("_by2"), F.explode(entered("s")).alias("_in"))
    packed = parts.join(begins, F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_stretch") == F.col("_in.stretch")))
    packed = packed.select("_by", F.explode(F.arrays_zip("rows", messages(sizes, "_in").alias("out"))).alias("x"))
    return packed.select(F.col("_by").alias(by), *(F.col(f"x.rows.{o}").alias(o) for o in order), F.col("x.out").alias("message"))
