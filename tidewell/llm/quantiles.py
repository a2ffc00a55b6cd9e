"""Percentiles per group over very large numeric columns, mergeable and with bounded error (problem 1).

Method: a q-digest.  Values are quantized to a bounded ordered universe of 2**24 cells (sign, exponent and the
first 12 bits of the fraction of a double, so a cell is at most 1/4096 of its value wide).  A digest holds
counts of nodes of the dyadic tree over that universe; children whose counts are small against ``n / k`` are
added to their parent.  Digests are merged by adding the counts of equal nodes.

Bound: let ``e = 24 * floor(n / k)``.  The value returned for the fraction ``q`` is an observed value; at least
``q * n`` values are not above it, and at most ``q * n + e`` values lie below its cell.  The bound is the same for
digests merged from any partition of the rows, as ``floor`` adds up to no more than that of the sum.
Groups of fewer than ``k`` rows are exact up to the cell.

Defined results for odd input: null, NaN and infinite values are left out; stray magnitudes are values; rows
with a repeated ``sample_id`` count once (rows without an id are all kept); a null or empty group is a group of
its own; a null day is a day; an empty table gives no rows; a group without finite values gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the fraction that a cell keeps, and the height of the tree.
FRACTION_BITS, LEVELS = 12, 24
#: A digest has at most about 3 * K nodes; the rank error is at most LEVELS / K = 0.5 % of n.
K = 4800


def node_of(x: Column) -> Column:
    """The leaf of the tree for a finite double, in order of the values: 2**24 .. 2**25 - 1."""
    size, cells = F.abs(x), float(1 << FRACTION_BITS)
    guess = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))), F.lit(-1022))
    power = F.pow(F.lit(2.0), guess.cast("double"))
    exponent = F.when(power > size, guess - 1).when(size / power >= 2.0, guess + 1).otherwise(guess)  # log2 may round across a power of two
    exponent = F.least(F.greatest(exponent, F.lit(-1022)), F.lit(1023))
    fraction = F.greatest(size / F.pow(F.lit(2.0), exponent.cast("double")) - 1.0, F.lit(0.0))  # below the normal numbers: the lowest cell
    index = ((exponent + 1022) * int(cells) + F.floor(fraction * cells)).cast("bigint")
    half, leaf = 1 << (LEVELS - 1), 1 << LEVELS
    return F.when(size == 0, F.lit(leaf + half)).when(x > 0, F.lit(leaf + half) + index).otherwise(F.lit(leaf + half - 1) - index).cast("bigint")


def _fold(group: np.ndarray, node: np.ndarray, count: np.ndarray, high: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sum up equal (group, node) pairs; sorted by them."""
    if not len(group):
        return group, node, count, high, limit
    order = np.lexsort((node, group))
    group, node, count, high, limit = (a[order] for a in (group, node, count, high, limit))
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])])
    return group[first], node[first], np.add.reduceat(count, first), np.maximum.reduceat(high, first), limit[first]


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Compress the digests of many groups at once, from the leaves up.

    ``group`` numbers the groups 0, 1, ...; the pairs (group, node) are unique.  Two siblings go into their parent
    if the three counts add up to less than ``floor(n / k)`` of their group.
    """
    limit = (np.bincount(group, weights=count).astype(np.int64) // k)[group]
    small = limit < 2  # nothing adds up to less than 1
    done = [a[small] for a in (group, node, count, high)]
    group, node, count, high, limit = (a[~small] for a in (group, node, count, high, limit))
    parts = [done]
    for level in range(LEVELS, 0, -1):
        if not len(group):
            break
        at = node >= (1 << level)
        if not at.any():
            continue
        parent = np.where(at, node >> 1, node)
        near = at | (node >= (1 << (level - 1)))  # this level and its parents
        g, p, c, lim = group[near], parent[near], count[near], limit[near]
        order = np.lexsort((p, g))
        first = np.flatnonzero(np.r_[True, (g[order][1:] != g[order][:-1]) | (p[order][1:] != p[order][:-1])])
        total = np.empty(len(order), np.int64)
        total[order] = np.repeat(np.add.reduceat(c[order], first), np.diff(np.r_[first, len(order)]))
        up = np.zeros(len(node), bool)
        up[np.flatnonzero(near)] = total < lim
        stay = at & ~up
        parts.append([a[stay] for a in (group, node, count, high)])
        rest = ~stay
        node = np.where(at & up, node >> 1, node)
        group, node, count, high, limit = _fold(*(a[rest] for a in (group, node, count, high, limit)))
    parts.append([group, node, count, high])
    return tuple(np.concatenate(x) for x in zip(*parts))


def _compressed(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Compress the digests in ``nodes`` (keys, node, cnt, high), one per combination of keys.

    A digest arrives with at most as many nodes as its values have cells (4,096 for each doubling), so its size
    is bounded whatever the number of rows.
    """
    schema = nodes.select(*keys, "node", "cnt", "high").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            if not t.num_rows:
                return
            change = np.zeros(t.num_rows, bool)
            for key in keys:
                codes = t[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            group = np.cumsum(change)
            starts = np.r_[0, np.flatnonzero(change)]
            g, node, cnt, high = compress(group, t["node"].to_numpy(), t["cnt"].to_numpy(), t["high"].to_numpy(), k)
            taken = t.select(keys).take(pa.array(starts[g]))
            done = pa.table([*taken.columns, pa.array(node), pa.array(cnt), pa.array(high)], names=[*keys, "node", "cnt", "high"])
            yield from done.combine_chunks().to_batches(max_chunksize=50_000)

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held[key][-1].as_py() for key in keys]
            # whole groups go out; the last one may go on in the next batch
            same = np.ones(held.num_rows, bool)
            for key, value in zip(keys, last):
                col = held[key].combine_chunks()
                same &= (pa.compute.is_null(col) if value is None else pa.compute.fill_null(pa.compute.equal(col, pa.scalar(value, col.type)), False)).to_numpy(zero_copy_only=False)
            cut = held.num_rows if not same.any() else held.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut > 100_000:
                yield from out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from out(held)

    import pyarrow.compute  # noqa: F401

    spread = nodes.select(*keys, "node", "cnt", "high").repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, schema)


def finite_values(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, measure, x): one row for each finite value."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])).alias("v")).select(*keys, "v.measure", "v.x")
    return long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))


def digests(rows: DataFrame, keys: list[str], measures: list[str], k: int = K) -> DataFrame:
    """One digest per combination of ``keys`` and measure: (keys, measure, node, cnt, high).

    Values are counted by cell before anything is shuffled, so a key with a third of all rows sends no more
    than its cells from each task.  ``high`` is the greatest value that a node has taken in.
    """
    finite = finite_values(rows, keys, measures)
    cells = finite.groupBy(*keys, "measure", node_of(F.col("x")).alias("node")).agg(F.count(F.lit(1)).alias("cnt"), F.max("x").alias("high"))
    return _compressed(cells, [*keys, "measure"], k)


def merge(partial: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merge digests to those of coarser ``keys`` by adding equal nodes, then compress again."""
    added = partial.groupBy(*keys, "measure", "node").agg(F.sum("cnt").alias("cnt"), F.max("high").alias("high"))
    return _compressed(added, [*keys, "measure"], k)


def percentiles(digest: DataFrame, keys: list[str], fractions: list[float], k: int = K) -> DataFrame:
    """(keys, measure, p, n, value, rank_error): the value of rank ``ceil(p * n)`` in each digest.

    Nodes are taken in the order of their upper ends, smaller nodes first.  A digest is bounded in size, so the
    window over it is too.
    """
    own = [*keys, "measure"]
    level = F.floor(F.log2(F.col("node").cast("double")) + 1e-9)  # ids are far below the point where this rounds wrongly
    end = (F.col("node") + 1) * F.pow(F.lit(2.0), F.lit(LEVELS) - level) - 1
    ordered = Window.partitionBy(*own).orderBy(F.col("end"), F.col("level").desc())
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*own)
    placed = digest.select(*own, "cnt", "high", level.alias("level"), end.alias("end"))
    placed = placed.select(*own, F.sum("cnt").over(running).alias("upto"), F.max("high").over(running).alias("value"), F.sum("cnt").over(whole).alias("n"), "cnt")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in fractions])).alias("p")
    rank = F.greatest(F.ceil(F.round(F.col("p") * F.col("n"), 6)), F.lit(1))
    hit = placed.select("*", wanted).where((F.col("upto") >= rank) & (F.col("upto") - F.col("cnt") < rank))
    return hit.select(*own, "p", "n", "value", (F.floor(F.col("n") / F.lit(k)) * LEVELS).alias("rank_error"))


def distinct_samples(iris: DataFrame) -> DataFrame:
    """The rows with each ``sample_id`` once; rows without an id are all kept."""
    own = F.when(F.col("sample_id").isNull(), F.monotonically_increasing_id())  # so that no key gathers rows without an id
    return iris.withColumn("__own", own).dropDuplicates(["sample_id", "__own"]).drop("__own")
