"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Rows of the incidence matrix are classes of documents with equal shingle sets, columns are hashed word
shingles. The columns of a row are put in one global order, those that very many rows hold last. If two sets
have Jaccard similarity t or more, they share a column among the first |x| - ceil(t |x|) + 1 of each (the
size-derived prefix), so only rows that share a column of that part can be linked.

The product is worked out in blocks of rows. A block's overlap counts are accumulated one column block after another, as
products of the block's part of the incidence matrix with itself; pairs are discarded once the columns that are left cannot
lift their count to ceil(t / (1 + t) (|x| + |y|)), and rows without a pair are dropped from the block.

Only what decides the components is multiplied. In each of a few rounds, rows are put in blocks by the least column of their
prefix (in a few orders, others in each round) and their size, which gathers near copies; a large group makes many blocks, and the
next round mixes its rows anew. Rows that are left outside a large component whose columns they share then meet a few of its members, so
that those which belong to it do not meet them all. What is left are columns of the prefixes whose rows are in several components: pairs of different
components that pass the bounds of sizes and places there, and of their counts in each block of columns, go into row blocks in
which both meet, whose product decides them. So a group of m near copies costs about its number of rows, and no link between components is missed.

Shingles are 64-bit hashes, sets are told apart by 128 bits. A column that workers do not report as frequent occurs at
most once in each COUNT_BYTES of text, so it is too small a part of any table to make a task long.
Defined results: null, empty or blank texts have an
empty set, are linked with nothing and form their own component; rows with a null id take no part in links and
have a null component; rows that repeat an id with the same text are one document (both rows are returned); links are between
ids, so an id that stands for different texts joins what each of them is linked with; ids are integers;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, stars_of
from .shared import Scratch, few, give_back, heavy_join, in_workers, slices, text_buffers, wanted
from .textkernel import BASE, ORDER, mix, shingle_sets, sums

#: Text bytes that are cut into shingles at once.
SLICE = 1 << 19
#: Text bytes over which a worker counts columns to find frequent ones, the count there that reports a column, and in all.
COUNT_BYTES, COUNT_LEAST, FREQUENT_LEAST = 32 << 20, 2, 8
#: Columns known as frequent at most (they only set the order, so any number gives the same pairs). 2 x 8 bytes each.
FREQUENT_MOST = 1 << 18
#: Entries of one column that one task counts, and of one tile of a column; pairs of tiles looked at at once, about.
CHUNK, TILE_PAIRS = 512, 1 << 18
#: Rounds of row blocks, and keys of each row in a round; rows and entries of a row block; columns of a column block.
ROUNDS, KEYS, BLOCK_ROWS, BLOCK_ENTRIES, BLOCK_COLUMNS = 2, 2, 256, 1 << 18, 2048
#: Members of a large component that rows outside it meet first; a component is large where more of its rows have one column.
MEMBERS = 32
#: Rows of one key of a round that one task takes, about; first bits by which most columns are told to be rare.
KEY_ROWS, FILTER_BITS = 4096, 20

SET_SCHEMA = "id long, h long, n long, s1 long, s2 long, counts binary, column long, count long"
DESCRIBED = [x.split(" ")[0] for x in SET_SCHEMA.split(", ")]


@dataclass(frozen=True)
class Jaccard:
    """Similarity at least `num / den` over distinct shingles of `width` words."""

    width: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.num * n // self.den) + 1

    def least(self, n: np.ndarray) -> np.ndarray:
        """The overlap that sets with n elements together must reach."""
        return -(-self.num * n // (self.num + self.den))


def _sets(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(part.column("text"))
    return shingle_sets(data, offsets, width)


def _ids(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    a, b = mix(values ^ np.uint64(0x5851F42D4C957F2D)), mix(values + np.uint64(0x14057B7EF767814F))
    return sums(a, bounds).view(np.int64), sums(b, bounds).view(np.int64)


def block_counts(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each row how many of its columns are in each block of hashes: bytes, 255 for that many or more. A row of n columns has n / 8 to n / 4 blocks."""
    n = np.diff(bounds)
    bits = np.maximum(2, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - 2)
    sizes = 1 << bits
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(n)), n)
    block = (values >> (64 - bits).astype(np.uint64)[owner]).astype(np.int64) + (ends - sizes)[owner]
    held = np.minimum(np.bincount(block, minlength=int(ends[-1]) if len(n) else 0), 255).astype(np.uint8).tobytes()
    return pa.array([held[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """The most columns that rows with these counts by block can share."""
    x, y = (np.where(c == 255, 1 << 40, c.astype(np.int64)) for c in (x, y))
    if len(x) < len(y):
        x, y = y, x
    return int(np.minimum(x.reshape(len(y), -1).sum(1), y).sum())


def _describe(rule: Jaccard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(every)))
            often = counts >= COUNT_LEAST
            none = pa.nulls(int(often.sum()), pa.int64())
            nothing = pa.nulls(int(often.sum()), pa.binary())
            return pa.RecordBatch.from_arrays([none] * 5 + [nothing, pa.array(every[first[often]].astype(np.int64)), pa.array(counts[often])], names=DESCRIBED)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                values, bounds = _sets(part, rule.width)
                s1, s2 = _ids(values, bounds)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), block_counts(values, bounds), none, none], names=DESCRIBED)
                held.append((values >> np.uint64(32)).astype(np.uint32))
                size += part.column("text").nbytes
                if size >= COUNT_BYTES:
                    yield frequent()
                    size = 0
        if held:
            yield frequent()
        give_back()

    return run


def _prefixes(rule: Jaccard, hot: np.ndarray, often: np.ndarray):
    """The first columns of each row in the global order, and the part to which the row goes in each that is dealt out (-1: it is not).

    Before them stand the keys of the rounds' row blocks, last round first: hashes of the least column in that round's order, and of the size.
    """
    # Most columns are told to be rare by a table of the first bits of frequent ones.
    some = np.zeros(1 << FILTER_BITS, bool)
    some[hot >> np.uint32(32 - FILTER_BITS)] = True

    def ranks(values: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(values), np.int64)
        upper = (values >> np.uint64(32)).astype(np.uint32)
        asked = np.flatnonzero(some[upper >> np.uint32(32 - FILTER_BITS)])
        if len(asked):
            at = np.minimum(np.searchsorted(hot, upper[asked]), len(hot) - 1)
            rank[asked] = np.where(hot[at] == upper[asked], often[at], 0)
        return rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                values, bounds = _sets(part, rule.width)
                s1, s2 = _ids(values, bounds)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                rank = ranks(values)
                # Rare columns are in order; the frequent ones follow, by their number.
                rare, rest = np.flatnonzero(rank == 0), np.flatnonzero(rank)
                rest = rest[np.lexsort((values[rest], rank[rest], owner[rest]))]
                n_rare = np.bincount(owner[rare], minlength=len(n))
                places = []
                for at, own in ((rare, np.zeros(len(n), np.int64)), (rest, n_rare)):
                    first = np.searchsorted(owner[at], np.arange(len(n)))
                    places.append(np.arange(len(at)) - (first - own)[owner[at]])
                lengths = np.where(n > 0, rule.prefix(n), 0)
                begin = np.concatenate(([0], np.cumsum(lengths)))
                order = np.zeros(begin[-1], np.int64)
                for at, place in zip((rare, rest), places, strict=True):
                    take = place < lengths[owner[at]]
                    order[begin[owner[at[take]]] + place[take]] = at[take]
                tokens, ranks_, owners = values[order], rank[order], owner[order]
                # Keys of the row blocks.
                full = np.flatnonzero(lengths)
                keys, key_ranks = np.zeros((len(full), ROUNDS * KEYS), np.uint64), np.zeros((len(full), ROUNDS * KEYS), np.int64)
                size = np.floor(2 * np.log2(np.maximum(n[full], 1))).astype(np.uint64)
                for k in range(ROUNDS * KEYS):
                    mixed = mix(tokens ^ mix(np.uint64(k + 1) * BASE))
                    least = np.minimum.reduceat(mixed, begin[full]) if len(full) else mixed
                    where = np.flatnonzero(mixed == np.repeat(least, lengths[full]))
                    # Of equal hashes (there should be none) any will do.
                    rank_of = np.zeros(len(n), np.int64)
                    rank_of[owners[where]] = ranks_[where]
                    keys[:, -1 - k] = mix(least + (size + np.uint64(1)) * ORDER[3] + np.uint64(k))
                    key_ranks[:, -1 - k] = rank_of[full]
                put = np.repeat(begin[full], ROUNDS * KEYS)
                tokens = np.insert(tokens, put, keys.ravel())
                parts = np.maximum(1, -(-ranks_ // CHUNK))
                parts = np.insert(parts, put, np.maximum(1, -(-key_ranks.ravel() // KEY_ROWS)))
                owners = np.insert(owners, put, np.repeat(full, ROUNDS * KEYS))
                deal = (mix(s1.view(np.uint64))[owners] % parts.astype(np.uint64)).astype(np.int32)
                cuts = pa.array(np.concatenate(([0], np.cumsum(np.where(lengths > 0, lengths + ROUNDS * KEYS, 0)))).astype(np.int32))
                columns = pa.ListArray.from_arrays(cuts, pa.array(tokens.view(np.int64)))
                dealt = pa.ListArray.from_arrays(cuts, pa.array(np.where(parts > 1, deal, -1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s1), pa.array(s2), pa.array(n), columns, dealt], names=["id", "s1", "s2", "n", "columns", "parts"])

    return run


def _whole_sets(rule: Jaccard, *carried: str):
    """The sets of the texts, as bytes of sorted 64-bit hashes, with the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                values, bounds = _sets(part, rule.width)
                sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], pa.array(sets, pa.binary())], names=[*carried, "values"])

    return run


def linked_pairs(sets: list[np.ndarray], rule: Jaccard) -> np.ndarray:
    """Which rows of a block have the similarity: the product of the block's incidence matrix with itself, by column block."""
    n = np.array([len(x) for x in sets])
    m = len(sets)
    least = rule.least(n[:, None] + n[None, :])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate(([0], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    # A column of one row alone adds to no count.
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    rest = np.bincount(owner, minlength=m)
    alive = np.minimum(rest[:, None], rest[None, :]) >= np.maximum(least, 1)
    np.fill_diagonal(alive, False)
    counts = np.zeros((m, m), np.float32)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, n_columns, BLOCK_COLUMNS):
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            break
        place = np.full(m, -1)
        place[rows] = np.arange(len(rows))
        a, b = np.searchsorted(column, [first, first + BLOCK_COLUMNS])
        own, at = place[owner[a:b]], column[a:b] - first
        own, at = own[own >= 0], at[own >= 0]
        block = np.zeros((len(rows), min(BLOCK_COLUMNS, n_columns - first)), np.float32)
        block[own, at] = 1
        square = np.ix_(rows, rows)
        counts[square] += block @ block.T
        rest[rows] -= np.bincount(own, minlength=len(rows))
        alive[square] &= counts[square] + np.minimum(rest[rows][:, None], rest[rows][None, :]) >= least[square]
    return alive


def _products(rule: Jaccard, keys: list[str], cut: bool):
    """Rows sorted by their keys: a forest of the links within each key. cut: a key's rows may go into several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        at, size = None, 0

        def linked() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                a, b = stars_of(linked_pairs(sets, rule), np.array(ids, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            ids.clear()
            sets.clear()

        for batch in batches:
            named = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, own, values in zip(named, batch.column("id").to_pylist(), batch.column("values"), strict=True):
                own_set = np.frombuffer(values.as_buffer(), np.uint64)
                if key != at or cut and (len(sets) == BLOCK_ROWS or size + len(own_set) > BLOCK_ENTRIES):
                    yield from linked()
                    at, size = key, 0
                ids.append(own)
                sets.append(own_set)
                size += len(own_set)
        yield from linked()
        give_back()

    return run


def _tile(rule: Jaccard):
    """Of tiles of columns: pairs of rows in different components that can have the similarity if they share no column before this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
            rows = batch.column(name)
            bounds = rows.offsets.to_numpy().astype(np.int64)
            return bounds, [rows.values.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n", "place", "component")]

        for batch in batches:
            (xb, (xi, xn, xp, xc)), (yb, (yi, yn, yp, yc)) = lists(batch, "xs"), lists(batch, "ys")
            major = batch.column("major").to_numpy(zero_copy_only=False)
            nx, ny = np.diff(xb), np.diff(yb)
            ends = np.cumsum(nx * ny)
            first = 0
            # All pairs of many small tiles at once.
            while first < len(nx):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TILE_PAIRS, side="right")))
                some = np.arange(first, last)
                tile = np.repeat(some, (nx * ny)[some])
                k = np.arange(len(tile)) - np.repeat((ends - nx * ny)[some] - (ends[first - 1] if first else 0), (nx * ny)[some])
                a, b = xb[tile] + k // ny[tile], yb[tile] + k % ny[tile]
                first = last
                # Of two rows outside the major component, which meet twice, the smaller id comes from the left.
                ok = np.flatnonzero((xc[a] != yc[b]) & ((yc[b] == major[tile]) | (xi[a] < yi[b])))
                a, b = a[ok], b[ok]
                least = rule.least(xn[a] + yn[b])
                ok = (np.minimum(xn[a], yn[b]) >= least) & (np.minimum(xn[a] - xp[a], yn[b] - yp[b]) >= least)
                low, high = np.minimum(xi[a[ok]], yi[b[ok]]), np.maximum(xi[a[ok]], yi[b[ok]])
                pairs = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
                for at in range(0, len(pairs), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 50_000, 0]), pa.array(pairs[at : at + 50_000, 1])], names=["a", "b"])

    return run


def _bounded(rule: Jaccard):
    """Pairs whose counts by block allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = rule.least(batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            ok = [most_shared(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) >= k for x, y, k in zip(batch.column("x"), batch.column("y"), least.tolist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def jaccard_components(docs: DataFrame, rule: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, text_hash) of every row: its set's size, the smallest id that links reach from it, and `text_hash` of its text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    described = scratch.keep(texts.withColumn("h", text_hash(F.col("text"))).transform(in_workers, _describe(rule), SET_SCHEMA), "described")
    rows = described.where("column IS NULL").select("id", "h", "n", "s1", "s2")
    known = rows.where("id IS NOT NULL AND n > 0")
    classes = scratch.keep(known.groupBy("s1", "s2").agg(F.min("id").alias("class"), F.count("*").alias("members")), "classes")

    # The frequent columns by the upper half of their hashes (a clash only moves a column in the order): at most
    # FREQUENT_MOST, so small enough for every task.
    counts = described.where("column IS NOT NULL").groupBy("column").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT_LEAST)
    top = counts.orderBy(F.desc("count"), "column").limit(FREQUENT_MOST).toPandas()
    hot, often = top["column"].to_numpy(np.uint32), top["count"].to_numpy(np.int64)
    by_hash = np.argsort(hot)
    hot, often = hot[by_hash], often[by_hash]

    # One row for each class: its first columns. An entry of the index is what one row has in one column.
    copies = scratch.keep(heavy_join(known, classes, ["s1", "s2"], "members").where("id != class").select("id", "s1", "s2"), "copies")
    prefixes = texts.where("id IS NOT NULL").transform(in_workers, _prefixes(rule, hot, often), "id long, s1 long, s2 long, n long, columns array<long>, parts array<int>")
    index = prefixes.join(few(copies), ["id", "s1", "s2"], "left_anti").select("id", "n", F.posexplode(F.arrays_zip("columns", "parts")).alias("place", "e"))
    # Size and place in one number: what is shuffled here is the largest table of all.
    index = index.select("id", "e.columns", F.col("e.parts").cast("long").alias("part"), (F.shiftleft("n", 32) + F.col("place")).alias("np")).withColumnRenamed("columns", "column")
    count = F.count("*").over(Window.partitionBy("column", "part"))
    index = index.withColumn("entries", count).where("entries > 1 OR part >= 0")
    place = F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") - ROUNDS * KEYS
    live = scratch.keep(index.select("id", F.shiftright("np", 32).alias("n"), "column", "part", place.alias("place")), "live-0")
    links = linked = None
    for k in range(1, ROUNDS + 3):
        if live.isEmpty():
            break
        if k <= ROUNDS:
            found = _gathered(texts, live, rule, scratch, k)
        else:
            found = _attached(texts, live, rule, scratch) if k == ROUNDS + 1 else _across(texts, live, described, rule, scratch)
        found = scratch.keep(found, f"links-{k}")
        if k == ROUNDS + 1 and found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        linked = components(links, scratch, f"graph{k}")
        if k <= ROUNDS + 1:
            live = _open(live, linked, scratch, k)
            scratch.drop(f"live-{k - 1}")
    # Rows are named by a skew-safe join with their class, so that no large class makes a task long.
    if linked is None:
        named = classes.withColumn("component_id", F.col("class"))
    else:
        named = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component_id", F.coalesce("component", "class"))
    named = scratch.keep(named.select("s1", "s2", "members", "component_id"), "named")
    scratch.drop_all_but("described", "named")
    named = heavy_join(known, named, ["s1", "s2"], "members").select("id", "n", "component_id", "h")
    alone = rows.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"), "h")
    return named.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("h").alias("text_hash"))


def text_hash(text: Column) -> Column:
    """64 bits that tell the texts of one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _gathered(texts: DataFrame, live: DataFrame, rule: Jaccard, scratch: Scratch, k: int) -> DataFrame:
    """Links (a, b) within the row blocks of a round."""
    member = scratch.keep(live.where(F.col("place").between(-k * KEYS, -1 - (k - 1) * KEYS)).select("id", F.col("column").alias("key"), "part"), f"members-{k}")
    sets = wanted(texts, member, ["id"]).transform(in_workers, _whole_sets(rule, "id", "key", "part"), "id long, key long, part long, values binary")
    return _multiplied(sets, ["key", "part"], rule, cut=True)


def _multiplied(sets: DataFrame, keys: list[str], rule: Jaccard, cut: bool) -> DataFrame:
    """A forest (a, b) of the links of rows (keys, id, values) with equal keys."""
    blocks = sets.repartition(*keys).sortWithinPartitions(*keys)
    return blocks.select(*keys, "id", "values").transform(in_workers, _products(rule, keys, cut), "a long, b long")


def _open(live: DataFrame, linked: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The entries of columns whose rows are in several components, with their component, and the column's number of entries and largest component."""
    entries = live.select("id", "n", "column", "part", "place").join(few(linked.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = entries.groupBy("column", "component").count().groupBy("column").agg(F.max_by("component", F.struct("count", "component")).alias("major"), F.count("*").alias("components"), F.sum("count").alias("entries"), F.max("count").alias("held"))
    sizes = scratch.keep(sizes.where("components > 1").drop("components"), f"columns-{k}")
    return scratch.keep(heavy_join(entries, sizes, ["column"], "entries").select("id", "n", "column", "part", "place", "component", "major", "entries", "held"), f"live-{k}")


def _attached(texts: DataFrame, live: DataFrame, rule: Jaccard, scratch: Scratch) -> DataFrame:
    """Links (a, b) of rows outside large components with MEMBERS rows of each whose columns they share: about one row for each entry, whatever the size of a component."""
    near = live.where(f"place >= 0 AND held > {MEMBERS}")
    outside = scratch.keep(near.where("component <> major").select(F.col("major").alias("key"), "id", "n").distinct(), "outside")
    if outside.isEmpty():
        return outside.select(F.col("id").alias("a"), F.col("id").alias("b"))
    parts = F.ceil(F.greatest(F.count("*") / (BLOCK_ROWS // 2), F.sum("n") / (BLOCK_ENTRIES // 2)))
    parts = scratch.keep(outside.groupBy("key").agg(parts.alias("parts"), F.count("*").alias("rows")), "outside-parts")
    order = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
    inside = near.where("component = major").select(F.col("major").alias("key"), "id").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= MEMBERS)
    inside = inside.join(parts, "key").select("key", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = heavy_join(outside, parts, ["key"], "rows").select("key", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    member = scratch.keep(dealt.union(inside), "attached")
    sets = wanted(texts, member, ["id"]).transform(in_workers, _whole_sets(rule, "id", "key", "part"), "id long, key long, part long, values binary")
    return _multiplied(sets, ["key", "part"], rule, cut=False)


def _across(texts: DataFrame, live: DataFrame, described: DataFrame, rule: Jaccard, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components: of pairs that share a column of their prefixes and pass the bounds."""
    entries = live.where("place >= 0").withColumn("tiles", F.ceil(F.col("entries") / CHUNK)).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    listed = F.collect_list(F.struct("id", "n", "place", "component"))
    every = entries.groupBy("column", "tile").agg(listed.alias("ys"))
    minor = entries.where("component <> major").groupBy("column", F.col("tile").alias("own"), "tiles", "major").agg(listed.alias("xs"))
    tiles = minor.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).join(every, ["column", "tile"])
    pairs = scratch.keep(tiles.select("major", "xs", "ys").transform(in_workers, _tile(rule), "a long, b long").distinct(), "met-pairs")
    # Counts by block of columns rule out many of them.
    counted = described.where("column IS NULL AND n > 0")
    x, y = counted.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("x")), counted.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("y"))
    pairs = scratch.keep(few(pairs).join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").transform(in_workers, _bounded(rule), "a long, b long").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    # Row blocks in which both rows of each pair meet: within the groups of rows that pairs connect, by a bucket of each row.
    groups = components(pairs, scratch, "groups")
    sizes = groups.join(live.select(F.col("id").alias("node"), "n").distinct(), "node").groupBy("component").agg(F.sum("n").alias("entries"), F.count("*").alias("members"))
    sizes = scratch.keep(sizes, "group-sizes")
    buckets = F.ceil(F.greatest(F.col("members") / (BLOCK_ROWS // 2), F.col("entries") / BLOCK_ENTRIES))
    placed = heavy_join(groups, sizes, ["component"], "members").select("node", "component", F.pmod(F.xxhash64("node"), buckets).alias("bucket"))
    met = pairs.join(placed.toDF("a", "group", "i"), "a").join(placed.select(F.col("node").alias("b"), F.col("bucket").alias("j")), "b")
    met = met.select("group", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.explode(F.array("a", "b")).alias("id")).distinct()
    met = scratch.keep(met.groupBy("id").agg(F.collect_list(F.struct("group", "i", "j")).alias("keys")), "met")
    number = met.agg(F.sum(F.size("keys"))).first()[0]
    sets = wanted(texts, met, ["id"], number=number).transform(in_workers, _whole_sets(rule, "id", "keys"), "id long, keys array<struct<group:long,i:long,j:long>>, values binary")
    return _multiplied(sets.select("id", "values", F.explode("keys").alias("key")).select("key.*", "id", "values"), ["group", "i", "j"], rule, cut=False)
