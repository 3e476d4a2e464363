"""Near-duplicate vectors by NN-descent.

Only vectors of one label and length are compared. Equal vectors (by 128 bits of hashes) are first put together as one node
with a count. A neighbour graph starts from windows over a few random projections; then each node introduces its
neighbours and those who list it to each other (pairs with at least one new entry), and every node keeps its best
ones, until few lists change. A list full of edges over the threshold is saturated and grows to four times its length; one
that is saturated then looks no further, as its vector's links no longer depend on it. Long lists of those who
list a node are dealt into parts, so that none is cut; a part hands on each member's best new pairs.

Every pair over the threshold that a window or an introduction meets ties its vectors, whether a list keeps the pair or
not (each task hands on a forest of its ties). Ties and lists give components. Within each component the links are then
counted exactly, for each pair of its tiles in a task, so a group of m near copies gives m rows, not its pairs.

What the descent has missed is closed exactly: all vectors of different components of one label and length are compared,
block by block, and pairs over the threshold join their components. This takes time with the square of a label, at the
speed of a matrix product in single precision; pairs near the threshold are decided in double precision. Every label is closed,
whatever its size; those of more than `close_most` vectors in a step of their own, so that their blocks are not on disk with the others'.
Then the audit counts all links of sampled vectors by brute force: firsts of components, other linked ones, and any; all of them
must have been found, or the run fails.

Defined results: a vector that is null, zero, or holds null or non-finite components, or whose label is null, is
linked with nothing and is its own component; rows that repeat an id with equal vectors count as copies of it; rows that repeat
an id with other vectors are vectors of their own, and the id's rows share the links' component; a
null id takes no part and has a null component; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .graph import components, stars_of
from .shared import Scratch, few, give_back, heavy_join, in_workers

#: Rows of a window of the start, and of a tile; members of a node that one task introduces to each other.
WINDOW, TILE, PART = 256, 512, 96
#: Numbers and rows of a block of the closing comparison at most; what rounding may change of a cosine in the audit.
BLOCK_NUMBERS, BLOCK, ROUNDING = 1 << 18, 4096, 1e-9


@dataclass(frozen=True)
class Descent:
    """Threshold, list length, projections of the start, rounds, share of changed lists that ends it, vectors of the audit, size over which labels are closed in a second step."""

    threshold: float = 0.98
    length: int = 8
    projections: int = 3
    rounds: int = 8
    settled: float = 0.01
    audit_rows: int = 256
    close_most: int = 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of float64 vectors of one length, from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _nodes(projections: int):
    """Unit vectors in double precision, and their places on random lines; unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            keep, units, places = [], [], []
            for k, x in enumerate(batch.column("vector")):
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
                if top > 0:
                    v = v / top
                    v = v / np.sqrt(v @ v)
                    if len(v) not in lines:
                        lines[len(v)] = np.random.default_rng(len(v)).standard_normal((projections, len(v)))
                    keep.append(k)
                    units.append(v.tobytes())
                    places.append(lines[len(v)] @ v)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("dim"), part.column("copies"), pa.array(units, pa.binary()), pa.array([p.tolist() for p in places], pa.list_(pa.float64()))], names=["id", "label", "dim", "copies", "unit", "places"])

    return run


FOUND = "u long, v long, sim double, tie boolean"


def _edges(u: list, v: list, s: list, ties: list) -> pa.RecordBatch:
    """Pairs for the lists, and the ties (u, v) beside them."""
    n = sum(map(len, u))
    u, v = u + [a for a, _ in ties], v + [b for _, b in ties]
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    s = np.concatenate([*s, np.full(len(u) - n, np.nan)])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(np.arange(len(u)) >= n)], names=["u", "v", "sim", "tie"])


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Of each row the columns of its k largest values."""
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _windows(k: int, threshold: float):
    """Sorted rows of a partition: each row's best ones in its window and the next, and the ties among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, WINDOW):
                part = batch.slice(at, WINDOW)
                groups = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64), part.column("dim").to_numpy()
                for dim in np.unique(groups[1]):
                    of = np.flatnonzero(groups[1] == dim)
                    here = part.take(pa.array(of))
                    ids, labels, units = here.column("id").to_numpy(), groups[0][of], _matrix(here.column("unit"))
                    if last is not None and last[3] == dim:
                        ids, labels, units = np.concatenate((last[0], ids)), np.concatenate((last[1], labels)), np.concatenate((last[2], units))
                    last = (here.column("id").to_numpy(), groups[0][of], _matrix(here.column("unit")), dim)
                    if len(ids) < 2:
                        continue
                    sims = np.where(labels[:, None] == labels[None, :], units @ units.T, -2.0)
                    np.fill_diagonal(sims, -2.0)
                    best = _best(sims, k)
                    u, v, s = np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()
                    ok = s > -2
                    yield _edges([u[ok]], [v[ok]], [s[ok]], [stars_of(sims >= threshold, ids)])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by whole-number keys, those of one key at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        named = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((named[1:] != named[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tuple(named[a].tolist()) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(named[a].tolist())
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _introduce(threshold: float, length: int):
    """Members of nodes, sorted by node and part: of each member its best pairs, one of the two new, that beat the worst in its list; ties of all members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss, ties, size = [], [], [], [], 0
        for rows in _grouped(batches, ["at", "part"]):
            ids, first, which = np.unique(rows.column("id").to_numpy(), return_index=True, return_inverse=True)
            if len(ids) < 2:
                continue
            new = np.bincount(which, weights=rows.column("new").to_numpy().astype(float)) > 0
            worst = rows.column("worst").to_numpy()[first]
            units = _matrix(rows.column("unit").take(pa.array(first)))
            sims = units @ units.T
            np.fill_diagonal(sims, -2.0)
            ties.append(stars_of(sims >= threshold, ids))
            wanted = np.where((sims > worst[:, None]) & (new[:, None] | new[None, :]), sims, -2.0)
            best = _best(wanted, length)
            found = np.take_along_axis(wanted, best, 1)
            a, k = np.nonzero(found > -2.0)
            us.append(ids[a])
            vs.append(ids[best[a, k]])
            ss.append(found[a, k])
            size += len(a) + len(ties[-1][0])
            if size >= 50_000:
                yield _edges(us, vs, ss, ties)
                us, vs, ss, ties, size = [], [], [], [], 0
        yield _edges(us, vs, ss, ties)
        give_back()

    return run


def _tiles(threshold: float):
    """For each vector of a tile the number of vectors of another tile that it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links = [], []
            for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
                x, y = x.values, y.values
                xi, yi, yc = x.field("id").to_numpy(), y.field("id").to_numpy(), y.field("copies").to_numpy()
                near = (_matrix(x.field("unit")) @ _matrix(y.field("unit")).T >= threshold) & (xi[:, None] != yi[None, :])
                ids.append(xi)
                links.append((near * yc[None, :]).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], names=["id", "links"])

    return run


def _merged(edges: DataFrame, length: int, threshold: float) -> DataFrame:
    """(u, worst, best): the list of each node's best edges (u, v, sim, new); saturated lists are four times as long.

    One shuffle: what is dealt out by u is dealt out by (u, v) too.
    """
    single = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("sim", "v", "new")), asc=False), 1, 4 * length)
    lists = single.groupBy("u").agg(best.alias("best")).withColumn("best", F.when((F.size("best") > length) & (F.try_element_at("best", F.lit(length))["sim"] < threshold), F.slice("best", 1, length)).otherwise(F.col("best")))
    last = F.element_at("best", -1)["sim"]
    # A list that is full of edges over the threshold takes no better ones: ties have them.
    worst = F.when(F.size("best") < length, F.lit(-2.0)).when((F.size("best") == 4 * length) & (last >= threshold), F.lit(2.0)).otherwise(last)
    return lists.select("u", worst.alias("worst"), "best")


def descend(nodes: DataFrame, plan: Descent, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, sim) of the neighbour graph of nodes (id, label, dim, unit, places), and ties (u, v): forests of all pairs over the threshold that were met."""
    partitions = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    start = None
    for k in range(plan.projections):
        line = nodes.repartitionByRange(partitions, "label", "dim", F.col("places")[k]).sortWithinPartitions("label", "dim", F.col("places")[k])
        found = line.select("id", "label", "dim", "unit").transform(in_workers, _windows(plan.length, plan.threshold), FOUND)
        start = found if start is None else start.union(found)
    found = scratch.keep(start, "found-0")
    ties = found.where("tie").select("u", "v")
    graph = scratch.keep(_merged(found.where("NOT tie").select("u", "v", "sim", F.lit(True).alias("new")), plan.length, plan.threshold), "graph-0")
    for k in range(1, plan.rounds + 1):
        edges = graph.select("u", F.explode("best").alias("e")).select("u", "e.v", "e.sim", "e.new")
        members = edges.select(F.col("u").alias("at"), F.col("v").alias("id"), "new").union(edges.select(F.col("v").alias("at"), F.col("u").alias("id"), "new"))
        busy = members.groupBy("at").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("any").select("at", F.ceil(F.col("n") / PART).alias("parts"))
        placed = members.join(busy, "at").select("at", F.pmod(F.xxhash64("id", F.lit(k)), F.col("parts")).alias("part"), "id", "new")
        known = nodes.select("id", "unit").join(graph.select(F.col("u").alias("id"), "worst"), "id", "left").select("id", "unit", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
        blocks = placed.join(known, "id").repartition("at", "part").sortWithinPartitions("at", "part")
        found = scratch.keep(blocks.select("at", "part", "id", "new", "worst", "unit").transform(in_workers, _introduce(plan.threshold, plan.length), FOUND), f"found-{k}")
        ties = ties.union(found.where("tie").select("u", "v"))
        seen = Observation()
        after = _merged(found.where("NOT tie").select("u", "v", "sim", F.lit(True).alias("new")).unionByName(edges.select("u", "v", "sim", F.lit(False).alias("new"))), plan.length, plan.threshold)
        after = after.observe(seen, F.sum(F.size("best")).alias("n"), F.sum(F.size(F.filter("best", lambda e: e["new"]))).alias("new"))
        after = scratch.keep(after, f"graph-{k}")
        scratch.drop(f"graph-{k - 1}")
        graph, change = after, seen.get
        if (change["new"] or 0) <= plan.settled * (change["n"] or 0):
            break
    return graph.select("u", F.explode("best").alias("e")).select("u", "e.v", "e.sim"), ties


def _across(threshold: float):
    """Pairs of components that hold a pair of vectors over the threshold, from one block of vectors and another (or itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column("blocks"):
                sides = []
                for rows in {0, len(blocks) - 1}:
                    rows = blocks[rows].values
                    names = rows.field("component").to_numpy()
                    order = np.argsort(names, kind="stable")
                    units = _matrix(rows.field("unit"))[order]
                    sides.append((names[order], units, units.astype(np.float32)))
                (xc, x, x32), (yc, y, y32) = sides[0], sides[-1]
                # Rounding of a single-precision product of unit vectors is less than this.
                least = threshold - (x.shape[1] + 8) * 2.0**-23
                found: set[tuple[int, int]] = set()
                for i in range(0, len(x), TILE):
                    for j in range(0, len(y), TILE):
                        of, to = xc[i : i + TILE], yc[j : j + TILE]
                        if of[0] == of[-1] == to[0] == to[-1]:
                            continue
                        near = x32[i : i + TILE] @ y32[j : j + TILE].T >= least
                        if not near.any():
                            continue
                        p, q = np.nonzero(near & (of[:, None] != to[None, :]))
                        for k in range(0, len(p), 1 << 14):
                            a, b = p[k : k + (1 << 14)], q[k : k + (1 << 14)]
                            sure = np.einsum("ij,ij->i", x[i + a], y[j + b]) >= threshold
                            found.update(zip(of[a[sure]].tolist(), to[b[sure]].tolist(), strict=True))
                pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _missed(nodes: DataFrame, labels: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of components that should be one, in these labels and lengths (label, dim, n): each pair of blocks is compared in a task."""
    placed = nodes.select("id", "label", "dim", "unit").join(labels, ["label", "dim"]).join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    most = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim"))))
    placed = placed.withColumn("blocks", F.ceil(F.col("n") / most)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(0)), F.col("blocks")))
    blocks = placed.groupBy("label", "dim", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("component", "unit")).alias("rows"))
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.groupBy("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return met.agg(F.collect_list("rows").alias("blocks")).select("blocks").transform(in_workers, _across(threshold), "a long, b long")


def _audit(nodes: DataFrame, linked: DataFrame, links: DataFrame, plan: Descent) -> list[tuple[int, int]]:
    """(label, dim) of the vectors of a bounded sample of which not all links, counted by brute force, have been found.

    A third of the sample are firsts of their components (most are alone), a third others that are linked, a third any.
    """
    rows = nodes.select("id", "label", "dim", "unit")
    others = linked.where("node != component").select(F.col("node").alias("id"))
    third = -(-plan.audit_rows // 3)
    drawn = [(0, rows.join(others, "id", "left_anti")), (1, rows.join(others, "id", "left_semi")), (2, rows)]
    every = [x.orderBy(F.xxhash64("id", F.lit(kind)), "id").limit(third) for kind, x in drawn]
    sample = every[0].union(every[1]).union(every[2]).toPandas().drop_duplicates("id")
    if not len(sample):
        return []
    by_dim = {dim: (g["id"].to_numpy(), g["label"].to_numpy(), np.frombuffer(b"".join(g["unit"]), np.float64).reshape(len(g), -1)) for dim, g in sample.groupby("dim")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim, (ids, labels, units) in by_dim.items():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if part.num_rows:
                    sims = units @ _matrix(part.column("unit")).T
                    own = (labels[:, None] == part.column("label").to_numpy()[None, :]) & (ids[:, None] != part.column("id").to_numpy()[None, :])
                    least, most = ((own & (sims >= t)) @ part.column("copies").to_numpy() for t in (plan.threshold + ROUNDING, plan.threshold - ROUNDING))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least), pa.array(most)], names=["id", "least", "most"])

    there = nodes.select("id", "label", "dim", "copies", "unit").transform(in_workers, run, "id long, least long, most long").groupBy("id").agg(F.sum("least").alias("least"), F.sum("most").alias("most"))
    wrong = there.join(links, "id", "left").where(~F.coalesce("links", F.lit(0)).between(F.col("least"), F.col("most"))).select("id").collect()
    missed = sample[sample["id"].isin([r["id"] for r in wrong])]
    return sorted({(int(r.label), int(r.dim)) for r in missed.itertuples()})


def near_duplicates(vectors: DataFrame, plan: Descent = Descent(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nndescent")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    fit = F.expr("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
    usable = rows.where(fit).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(7), "vector"))
    equal = ["label", "h1", "h2"]
    groups = usable.groupBy(*equal).agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # Nodes are numbered by the least id of their copies; where two nodes have it, one id has several vectors.
    groups = scratch.keep(groups, "groups")
    twice = scratch.keep(groups.groupBy("first").count().where("count > 1").select(F.col("first").alias("id")), "twice")
    own = F.when(F.col("id").isNull(), F.col("first")).otherwise(-1 - F.pmod(F.xxhash64("first", "h1", "h2"), F.lit(1 << 62)))
    groups = groups.join(few(twice), groups["first"] == twice["id"], "left").withColumn("node", own).drop("id")
    numbered = scratch.keep(groups.select(*equal, "first", "copies", "node"), "numbered")
    nodes = scratch.keep(groups.select(F.col("node").alias("id"), "label", F.size("vector").alias("dim"), "copies", "vector").transform(in_workers, _nodes(plan.projections), "id long, label long, dim int, copies long, unit binary, places array<double>"), "nodes")
    graph, ties = descend(nodes, plan, scratch)
    edges = graph.where(F.col("sim") >= plan.threshold).select("u", "v").union(ties).toDF("a", "b")
    linked = components(edges, scratch, "linked-0")
    sizes = scratch.keep(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), "labels")
    for k, some in (1, sizes.where(F.col("n") <= plan.close_most)), (2, sizes.where(F.col("n") > plan.close_most)):
        number = some.count()
        if not number:
            continue
        missed = scratch.keep(_missed(nodes, few(some, number), linked, plan.threshold), f"missed-{k}")
        if not missed.isEmpty():
            linked = components(linked.toDF("a", "b").union(missed), scratch, f"linked-{k}")
    links = scratch.keep(_links(nodes, linked, plan.threshold, scratch), "links")
    if wrong := _audit(nodes, linked, links, plan):
        raise RuntimeError(f"links are missed in the labels and lengths {wrong}")
    # Rows that share an id: the id is in one component, that of its first node.
    per_node = nodes.select(F.col("id").alias("node"), "copies").join(linked, "node", "left").join(links.withColumnRenamed("id", "node"), "node", "left")
    per_node = per_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = scratch.keep(numbered.join(per_node, "node", "left").select(*equal, "first", "copies", "n_links", "component"), "per-node")
    # A component is named by the least id of its rows.
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    least = scratch.keep(least, "least")
    placed = heavy_join(named.where("component IS NOT NULL"), least, ["component"], "members").select(*equal, "copies", "n_links", "component_id")
    placed = scratch.keep(placed.unionByName(named.where("component IS NULL").select(*equal, "copies", "n_links", F.lit(None).cast("long").alias("component_id"))), "placed")
    narrow = scratch.keep(usable.select("id", *equal), "narrow")
    scratch.drop_all_but("placed", "narrow")
    done = heavy_join(narrow, placed, equal, "copies").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    done = done.union(rows.where(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long"), F.col("id")))
    return done.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(nodes: DataFrame, linked: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(id, links) of the nodes in components of two or more: copies of linked nodes, counted for each pair of tiles in a task."""
    sizes = scratch.keep(linked.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    placed = heavy_join(linked, sizes, ["component"], "n").select(F.col("node").alias("id"), "component", F.ceil(F.col("n") / TILE).alias("tiles"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))).join(nodes.select("id", "copies", "unit"), "id")
    tiles = placed.groupBy("component", "tile").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("id", "copies", "unit")).alias("xs"))
    tiles = scratch.keep(tiles, "tiles")
    other = tiles.select("component", F.col("tile").alias("other"), F.col("xs").alias("ys"))
    pairs = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).join(other, ["component", "other"])
    # One row for each pair of tiles goes to a task of its own key, so that a large component is dealt out.
    return pairs.select("xs", "ys").transform(in_workers, _tiles(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
