"""Mixing sources to target weights by Pfair scheduling.

Rows of each source are put in a fixed pseudo-random order (by MD5 of the id) and cut into blocks of equal size. The
target is a fluid: in every slot each source that has rows left gets its share of one block, its weight over the weights of
those sources; when one is used up, the others share its part in proportion. The k-th block (from 1) of a source is
released in the slot in which its fluid begins and due at the end of the slot in which it ends; in every slot the
released block with the earliest deadline goes next. The fluid fills every slot, so every block meets its deadline, and at any
time each source is less than one block away from its target, counted from the beginning. As long as no source is used up, these are
the windows floor((k - 1) / w) and ceil(k / w) of a weight w.

Weights are exact fractions (of their decimal form), so nothing drifts however many blocks there are. With v, the fluid's
time, source i has got min(w_i v, n_i) of its n_i blocks; the sum of these is the slot, which the driver knows in closed form
between the times at which sources end. It deals out one block after another, in whole numbers, and the slots come back as a
table of one row for each block. Blocks are larger where there are more than MOST_BLOCKS of them, so that the driver's work and
the table have a bound (MOST_BLOCKS and one for each source). No row is dropped or repeated.

Places in a source come from a count for each bucket of the hash and a row number within the bucket, so that a source
with most of the rows is dealt over many tasks.

Defined results: a null source is a source of its own, and so is an empty one; a source without a given weight gets the
mean of the given ones; a weight that is not positive counts as 1 of PARTS of the sum of the others (as 1 if there are none); rows that
repeat an id have places of their own, in no defined order among equal rows; a null id counts as an empty one; all columns of the input
are kept whatever their names: a column of the schedule (prefixed with `mix_`) whose name is taken has underscores behind its name.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, free_name

#: Rows of a block at least, blocks of all sources at most (about), parts of which a source without a positive weight gets one, and hexadecimal digits of a bucket of the order.
BLOCK_ROWS, MOST_BLOCKS, PARTS, BUCKET_DIGITS = 64, 1 << 18, 1000, 3
#: The largest deadline that is told apart.
LATEST = 1 << 62
#: Columns of the schedule.
COLUMNS = ("mix_source", "mix_place", "mix_block", "mix_release", "mix_due", "mix_phase", "mix_slot")


def exact(weights: Mapping[str, float], parts: int = PARTS) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    given = {n: max(Fraction(str(w)), Fraction(0)) for n, w in weights.items()}
    least = sum(given.values(), Fraction(0)) / parts or Fraction(1)
    given = {n: w or least for n, w in given.items()}
    whole = lcm(*(w.denominator for w in given.values()))
    return {n: int(w * whole) for n, w in given.items()}


class Fluid:
    """The target: how many slots have passed when a source has got so much."""

    def __init__(self, blocks: Mapping[str, int], own: Mapping[str, int]):
        names = sorted(blocks, key=lambda n: Fraction(blocks[n], own[n]))
        # Times at which sources end, what has ended before each, and the weights that are left after it.
        self.ends = [Fraction(blocks[n], own[n]) for n in names]
        self.ended = [0, *accumulate(blocks[n] for n in names)]
        total = sum(own.values())
        self.left = [total, *(total - w for w in accumulate(own[n] for n in names))]

    def slots(self, got: int, weight: int) -> tuple[int, int]:
        """The slots (whole, and whether a part of one more) that have passed when a source of this weight has got `got` blocks."""
        k = bisect_right(self.ends, Fraction(got, weight))
        whole, rest = divmod(got * self.left[k], weight)
        return self.ended[k] + whole, int(rest > 0)

    def phases(self) -> list[int]:
        """The first slots after which one more source has ended."""
        return [ended + -(-end.numerator * left // end.denominator) for end, ended, left in zip(self.ends, self.ended[1:], self.left[1:], strict=True)]


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], parts: int = PARTS) -> dict[str, np.ndarray | list[str]]:
    """Columns of one row for each block, in the order of slots: of the released blocks the one due first has the next slot."""
    blocks = {n: k for n, k in blocks.items() if k > 0}
    own = exact({n: weights[n] for n in blocks}, parts)
    fluid = Fluid(blocks, own)
    names = sorted(blocks)
    out = {c: array("q") for c in ("source", "mix_block", "mix_release", "mix_due", "mix_slot")}
    # Of each source the block that is next: (release, due, source, number).
    waiting: list[tuple[int, int, int, int]] = []
    ready: list[tuple[int, int, int, int]] = []

    def come(source: int, block: int, release: int) -> None:
        due, part = fluid.slots(block + 1, own[names[source]])
        heapq.heappush(waiting, (release, due + part, source, block))

    for source in range(len(names)):
        come(source, 0, 0)
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            release, due, source, block = heapq.heappop(waiting)
            heapq.heappush(ready, (due, source, block, release))
        due, source, block, release = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError(f"block {block} of {names[source]} missed its deadline {due}")
        for column, value in zip(out.values(), (source, block, release, min(due, LATEST), slot), strict=True):
            column.append(value)
        if block + 1 < blocks[names[source]]:
            come(source, block + 1, fluid.slots(block + 1, own[names[source]])[0])
    found = {c: np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for c, x in out.items()}
    found["mix_phase"] = np.searchsorted(np.array(sorted(fluid.phases()), np.int64), found["mix_slot"], side="right")
    return {"mix_source": [names[k] for k in found.pop("source").tolist()], **found}


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS, parts: int = PARTS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows with mix_source, mix_place (in the source), mix_block (from 0), mix_release, mix_due (slots), mix_phase (sources ended before) and mix_slot.

    Without weights, each source has its number of rows to the given power.
    """
    key = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")))
    source = F.coalesce(docs[source_col].cast("string"), F.lit("\0null"))
    # The row is one column on the way, so that its names meet none of those here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), source.alias("mix_source"), key.alias("key"), docs[id_col].alias("id")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    # One row for each source and bucket: at most 16^BUCKET_DIGITS for each source.
    counts = docs.select(source.alias("mix_source"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket")).groupBy("mix_source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    sizes = {r["mix_source"]: r["n"] for r in counts.groupBy("mix_source").agg(F.sum("n").alias("n")).collect()}
    given = {("\0null" if n is None else n): float(w) for n, w in (weights or {}).items()}
    mean = sum(given.values()) / len(given) if given else 1.0
    wanted = {n: given.get(n, mean) if given else size**power for n, size in sizes.items()}
    block_rows = max(block_rows, -(-sum(sizes.values()) // MOST_BLOCKS))
    slots = schedule({n: -(-size // block_rows) for n, size in sizes.items()}, wanted, parts)
    slot_table = docs.sparkSession.createDataFrame(pa.table({c: pa.array(x, pa.string() if c == "mix_source" else pa.int64()) for c, x in slots.items()}))
    if len(slots["mix_slot"]) <= BROADCAST_ROWS:
        slot_table = F.broadcast(slot_table)

    within = Window.partitionBy("mix_source", "bucket").orderBy("key", "id")
    placed = rows.withColumn("number", F.row_number().over(within)).join(offsets, ["mix_source", "bucket"])
    placed = placed.withColumn("mix_place", F.col("before") + F.col("number") - 1).withColumn("mix_block", F.floor(F.col("mix_place") / block_rows))
    placed = placed.join(slot_table, ["mix_source", "mix_block"]).withColumn("mix_source", F.when(F.col("mix_source") != "\0null", F.col("mix_source")))
    own = schedule_columns(docs.columns)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[F.col(c).alias(own[c]) for c in COLUMNS])


def schedule_columns(columns: list[str]) -> dict[str, str]:
    """What the columns of the schedule are called beside these columns of the input."""
    return {c: free_name(c, columns) for c in COLUMNS}


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in their mixed order: files written from it hold the slots one after another."""
    own = schedule_columns(columns)
    return mixed.repartitionByRange(F.col(own["mix_slot"]), F.col(own["mix_place"])).sortWithinPartitions(own["mix_slot"], own["mix_place"]).select(*columns)
