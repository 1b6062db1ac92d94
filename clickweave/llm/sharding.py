"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Where a shuffled row goes is decided per block (an input partition), not per row:

1. every block is permuted locally and stored with its rows' places;
2. the matrix of how many rows each block sends to each shard is drawn. In a uniform
   shuffle into shards of fixed sizes it is distributed multivariate hypergeometrically;
   it is drawn down a tree over the blocks, ``ARITY`` children a node, so that neither the
   driver nor one task sees all blocks, and its row and column sums are exact;
3. the first rows of a block go to shard 0, the next ones to shard 1, and so on;
4. every shard is permuted again: rows are ranked by a stored random number, in ranges of
   it of about ``RANGE_ROWS`` rows, so a shard needs no task of its own.

Sizes of shards differ by one row at most. Counts are drawn by inversion outwards from the
mode; the tail left out is less likely than the resolution of the 53-bit numbers drawn.
All of it is DataFrame functions. Random numbers are stored before they are used, so tasks
that run again give the same rows; the matrix depends on the block sizes and ``seed`` alone.

Defined results: null and empty texts, null ids and repeated rows are rows like others; with
fewer rows than shards some shards stay empty; an empty table gives no rows. Names of further
columns are free, save those added (``shard``, ``slot``), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.llm.common import materialise

#: Children of a node of the block tree.
ARITY = 16
#: Rows that are ranked together, about.
RANGE_ROWS = 100_000
#: Standard deviations searched beside the mode, and counts in any case.
_SPREAD, _LEAST = 12, 40

_BLOCK, _PLACE, _ROW, _RANDOM = "__block", "__place", "__row", "__random"


def size_of(text: Column) -> Column:
    """Bytes of a text in UTF-8 (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` items drawn from ``total`` are among the ``good`` ones, for a uniform ``u``.

    Weights relative to the mode's are summed upwards and downwards by their recurrence, and
    the count is where their running sum reaches ``u`` times the whole.
    """
    d = lambda c: c.cast("double")
    low = F.greatest(F.lit(0).cast("bigint"), draws + good - total)
    high = F.least(draws, good)
    mode = F.floor(d(draws + 1) * d(good + 1) / d(total + 2)).cast("bigint")
    mode = F.least(F.greatest(mode, low), high)
    share = d(good) / F.greatest(d(total), F.lit(1.0))
    rest = d(total - draws) / F.greatest(d(total - 1), F.lit(1.0))
    deviation = F.sqrt(F.greatest(d(draws) * share * (1 - share) * rest, F.lit(0.0)))
    reach = F.ceil(deviation * _SPREAD).cast("bigint") + _LEAST
    bad = total - good

    def upwards(k: Column) -> Column:
        return d(good - k) * d(draws - k) / (d(k + 1) * d(bad - draws + k + 1))

    def downwards(k: Column) -> Column:
        return d(k) * d(bad - draws + k) / (d(good - k + 1) * d(draws - k + 1))

    def steps(first: Column, last: Column, step: int) -> Column:
        empty = F.array().cast("array<bigint>")
        there = first <= last if step > 0 else first >= last
        return F.when(there, F.sequence(first, F.when(there, last).otherwise(first), F.lit(step).cast("bigint"))).otherwise(empty)

    up = steps(mode, F.least(high, mode + reach) - 1, 1)
    down = steps(mode, F.greatest(low, mode - reach) + 1, -1)
    one, zero = F.lit(1.0), F.lit(0.0)

    def weight(ks: Column, ratio) -> Column:
        start = F.struct(one.alias("w"), zero.alias("sum"))

        def add(s: Column, k: Column) -> Column:
            w = s["w"] * ratio(k)
            return F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))

        return F.aggregate(ks, start, add)["sum"]

    def found(ks: Column, ratio, step: int, before: Column, target: Column) -> Column:
        """The count where the running sum reaches the target, else null."""
        start = F.struct(one.alias("w"), before.alias("sum"), F.lit(None).cast("bigint").alias("k"))

        def add(s: Column, k: Column) -> Column:
            w = s["w"] * ratio(k)
            reached = F.when(s["sum"] + w >= target, k + step)
            return F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), F.coalesce(s["k"], reached).alias("k"))

        return F.aggregate(ks, start, add)["k"]

    above, below = weight(up, upwards), weight(down, downwards)
    sums = F.array(F.struct(above.alias("above"), (u * (1 + above + below)).alias("target")))
    return F.transform(
        sums,
        lambda s: F.when(s["target"] <= 1, mode).otherwise(
            F.coalesce(
                found(up, upwards, 1, one, s["target"]), found(down, downwards, -1, 1 + s["above"], s["target"]),
                mode,  # where rounding leaves the very last sum short of the target
            )
        ),
    )[0]


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def dealt(capacities: Column, rows: Column, *key: Column) -> Column:
    """Of a shuffled supply with ``capacities`` left per shard, what the next ``rows`` rows take of each."""
    start = F.struct(
        F.aggregate(capacities, F.lit(0).cast("bigint"), lambda s, c: s + c).alias("total"),
        rows.alias("rows"),
        F.array().cast("array<bigint>").alias("taken"),
    )

    def take(s: Column, capacity: Column) -> Column:
        u = uniform(*key, F.size(s["taken"]))
        return _bound(
            hypergeometric(s["total"], capacity, s["rows"], u),
            lambda k: F.struct(
                (s["total"] - capacity).alias("total"), (s["rows"] - k).alias("rows"),
                F.array_append(s["taken"], k).alias("taken"),
            ),
        )

    return F.aggregate(capacities, start, take)["taken"]


def communication_matrix(blocks: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``block``, ``sent`` (rows to each shard) for blocks given as ``block``, ``rows``."""
    blocks = blocks.select(F.col("block").cast("bigint"), F.col("rows").cast("bigint"))
    total, last = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("block"), F.lit(0))).first()
    depth = 1
    while ARITY**depth <= last:
        depth += 1
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    node = None
    for level in range(depth - 1, -1, -1):
        width = ARITY**level
        child = F.floor(F.col("block") / width).cast("bigint")
        children = (
            blocks.groupBy(child.alias("child")).agg(F.sum("rows").alias("rows"))
            .groupBy(F.floor(F.col("child") / ARITY).cast("bigint").alias("node"))
            .agg(F.sort_array(F.collect_list(F.struct("child", "rows"))).alias("children"))
        )
        start = F.struct(F.col("left"), F.array().cast("array<struct<child:bigint,sent:array<bigint>>>").alias("done"))

        def deal(state: Column, c: Column) -> Column:
            return _bound(
                dealt(state["left"], c["rows"], F.lit(seed), c["child"], F.lit(level)),
                lambda sent: F.struct(
                    F.zip_with(state["left"], sent, lambda a, b: a - b).alias("left"),
                    F.array_append(state["done"], F.struct(c["child"].alias("child"), sent.alias("sent"))).alias("done"),
                ),
            )

        done = F.aggregate("children", start, deal)["done"]
        # The root has all of every shard to give.
        whole = F.array(*[F.lit(n).cast("bigint") for n in sizes])
        node = children.withColumn("left", whole) if node is None else node.join(children, "node")
        node = node.select(F.explode(done).alias("c")).select(F.col("c.child").alias("node"), F.col("c.sent").alias("left"))
        # A level follows from the one above; stored, it is drawn once.
        node = materialise(node, "matrix")
    return node.select(F.col("node").alias("block"), F.col("left").alias("sent"))


def shuffle_to_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All ``rows`` with ``shard`` and ``slot``: a uniform shuffle cut into shards of equal size."""
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    placed = (
        rows.select(*columns)
        .withColumns({_RANDOM: F.rand(seed), "__order": F.rand(seed + 1)})
        .sortWithinPartitions("__order")
        .withColumns({_BLOCK: F.spark_partition_id().cast("bigint"), _ROW: F.monotonically_increasing_id()})
        .withColumn(_PLACE, F.col(_ROW) - F.shiftleft(F.col(_BLOCK), 33))
        .drop("__order")
    )
    placed = materialise(placed, "permuted")
    counted = placed.groupBy(F.col(_BLOCK).alias("block")).agg(F.count("*").alias("rows"))
    matrix = communication_matrix(counted, shards, seed)
    ends = F.aggregate(
        "sent", F.array().cast("array<bigint>"),
        lambda s, n: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("bigint")) + n),
    )
    ends = matrix.select(F.col("block").alias(_BLOCK), ends.alias("__ends"))
    shard = F.size(F.filter("__ends", lambda e: e <= F.col(_PLACE)))
    sent = placed.join(ends, _BLOCK).withColumn("shard", shard).drop("__ends", _BLOCK, _PLACE)
    return _ranked(sent, placed.count(), shards)


def _ranked(sent: DataFrame, total: int, shards: int) -> DataFrame:
    """``slot``: the rank of a row's random number within its shard, in ranges of that number."""
    ranges = max(1, -(-total // (shards * RANGE_ROWS)))
    part = F.floor(F.col(_RANDOM) * ranges).cast("bigint")
    sent = materialise(sent.withColumn("__range", part), "sent")
    counts = sent.groupBy("shard", "__range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__range").orderBy(_RANDOM, _ROW)
    ranked = sent.withColumn("__rank", F.row_number().over(within)).join(starts, ["shard", "__range"])
    return ranked.withColumn("slot", F.col("__start") + F.col("__rank") - 1).drop("__range", "__rank", "__start", _RANDOM, _ROW)


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Shards as folders ``shard=0`` and on, rows of a file in the order of their slots."""
    (
        shuffle_to_shards(rows, shards, seed)
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
