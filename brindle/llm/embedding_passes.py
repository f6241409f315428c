"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector a key of bits, sorts all vectors by it, and compares each with the `window` before it in
exact double-precision products. The leading bits are the path down a tree of random projections, each node of which
splits at the median of a sample; the others are the signs of projections of the vector less the mean of its leaf. So
keys split a hot cone or a cluster as evenly as isotropic vectors, wherever the mean lies.

How many passes and how wide a window it takes is measured first (`plan`), at every size: pairs at just the threshold are
made of vectors of the sample, towards others of it and towards their neighbours in key order, and of the passes and
windows that bring the worse kind together with probability `RECALL` the cheapest are taken, never fewer than PASSES and
WINDOW; there is no upper bound on passes, which are done in rounds of `ROUND`. A very hot cone may ask for more
comparisons than there are pairs (and than a round has). Then (`Plan.exact`) all vectors are compared in blocks of the sorted order: a vector
goes to another block only if its angle to that block's centre is within the block's radius and the threshold's angle,
which loses no link.

The sorted rows of all passes are numbered, and cut into blocks of many windows by number; a block also gets the last
`window` rows before it. So what is found depends neither on partitions nor on their borders, and equal keys don't
meet in one task. A task keeps the links of a spanning forest of what it finds; these are united into components.

A window bounds the comparisons, not the result: within each component every pair is then compared in blocks of
members, and counted where it lies, so that a group of thousands of near copies has all its links counted and none
written out. Equal vectors are one node with a weight; copies cost nothing.

A pair at the threshold is lost only if it shares a window in none of the passes and no chain of links ties its ends; in
the exact way none is.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of different lengths don't link; repeated rows are copies of one another; a row with a null id counts as a copy or
neighbour and takes part in components by its vector alone; an id of several vectors is a row of each; an empty table
gives an empty result. Float components are compared as the doubles that they are, double ones unrounded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import hot_join, load, shuffle_width, staged, unstage
from .components import components

THRESHOLD = 0.95
PASSES = 16
WINDOW = 96
BITS = 48
#: The probability with which a pair at the threshold is to share a window in some pass, and how wide a window may get.
RECALL = 0.995
WIDEST = 6144
#: What a pass costs a vector besides its window, in comparisons; passes that are done at a time.
PER_PASS, ROUND = 1024, 64
#: Blocks of the exact way, at most, and bytes of their centres; vectors of a block, at least.
BLOCKS, CENTRE_BYTES, LEAST_BLOCK = 4096, 64 << 20, 256
#: Vectors (and bytes of them) in the sample that the trees are made of; sampled vectors of a leaf; pairs and passes of the measurement.
SAMPLE, SAMPLE_BYTES, LEAF, PROBES, PROBE_PASSES = 32768, 32 << 20, 32, 1000, 24
#: Members of a block when a component's pairs are counted: a 16th of the component within these bounds.
EDGE = (64, 4096)


def unit_rows(vectors: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (shorter ones padded with zeros), and their true lengths."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    out = np.zeros((len(vectors), int(lengths.max(initial=1))))
    for n in np.unique(lengths):
        out[lengths == n, :n] = [v for v in vectors if len(v) == n]
    largest = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(largest > 0, largest, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300), lengths


def planes(length: int, seed: int, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng([seed, length]).normal(size=(length, bits))


def unit_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """unit_rows of an Arrow list column; without Python lists where all have one length."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and lengths[0] and (lengths == lengths[0]).all() and not column.null_count:
        out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)
        out /= np.abs(out).max(axis=1, keepdims=True)
        return out / np.linalg.norm(out, axis=1, keepdims=True), lengths.astype(np.int64)
    return unit_rows(column.to_pylist())


class Tree:
    """The key of a pass for unit vectors of one length: a path of median splits, then signs about the leaf's mean."""

    def __init__(self, sample: np.ndarray, length: int, seed: int, bits: int = BITS):
        self.length, self.seed, self.bits = length, seed, bits
        self.medians: list[np.ndarray] = []
        at = sample @ planes(length, seed, bits)
        path = np.zeros(len(at), np.int64)
        for level in range(max(0, int(np.log2(max(1, len(at)) / LEAF)))):
            order = np.lexsort((at[:, level], path))
            starts = np.searchsorted(path[order], np.arange(1 << level))
            counts = np.bincount(path, minlength=1 << level)
            middle = at[order, level][np.minimum(starts + counts // 2, len(at) - 1)]
            self.medians.append(np.where(counts > 0, middle, 0.0))
            path = path * 2 + (at[:, level] >= self.medians[-1][path])
        depth, leaves = len(self.medians), 1 << len(self.medians)
        sums = np.zeros((leaves, bits - depth))
        np.add.at(sums, path, at[:, depth:])
        self.means = (sums / np.maximum(np.bincount(path, minlength=leaves), 1)[:, None]).astype(np.float32)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        at = unit @ planes(self.length, self.seed, self.bits)
        path = np.zeros(len(at), np.int64)
        for level, medians in enumerate(self.medians):
            path = path * 2 + (at[:, level] >= medians[path])
        rest = self.bits - len(self.medians)
        signs = at[:, len(self.medians) :] > self.means[path]
        return path << rest | signs @ (1 << np.arange(rest - 1, -1, -1, dtype=np.int64))


def threshold_pairs(unit: np.ndarray, order: np.ndarray, threshold: float, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a sample, and for each one at the threshold's angle towards another: any, or one of those close in order."""
    rng = np.random.default_rng(1)
    place = rng.integers(0, len(unit), PROBES)
    other = (place + rng.integers(1, 17, PROBES) * rng.choice([-1, 1], PROBES)) % len(unit) if near else rng.integers(0, len(unit), PROBES)
    x, z = unit[order[place]], unit[order[other]]
    cosine = (x * z).sum(1)
    apart = (cosine < threshold) & (cosine > -0.999)
    x, z, cosine = x[apart], z[apart], cosine[apart, None]
    away = (z - cosine * x) / np.sqrt(1 - cosine**2)
    return x, threshold * x + np.sqrt(1 - threshold**2) * away


@dataclass(frozen=True)
class Plan:
    """The passes and the window to take and the recall that they are to have, or exact: all pairs of blocks."""

    passes: int
    window: int
    recall: float
    exact: bool = False


def plan(sample: np.ndarray, nodes: int, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> Plan:
    """What finds pairs at the threshold among so many vectors of the sample's kind at the least cost."""
    if len(sample) < 2:
        return Plan(passes, window, 1.0)
    length = sample.shape[1]
    trees = [Tree(sample, length, 1000 + seed) for seed in range(PROBE_PASSES)]
    order = np.argsort(trees[0].keys(sample), kind="stable")
    chances = []
    for near in (False, True):
        x, y = threshold_pairs(sample, order, threshold, near)
        if len(x):
            same = np.zeros(len(x))
            for tree in trees:
                differing = tree.keys(x) ^ tree.keys(y)
                same += tree.bits - np.where(differing > 0, np.floor(np.log2(np.maximum(differing, 1))) + 1, 0)
            chances.append(same / (same + PROBE_PASSES))  # of one more equal bit, as long as all were equal
    most = max(nodes / 2, ROUND * (window + PER_PASS))  # beyond all pairs, and a round of passes, all pairs it is
    best, w = None, window
    while True:
        depth, k = max(0.0, np.log2(max(nodes, 1) / w)), passes
        while (recall := min((float(np.mean(1 - (1 - p**depth) ** k)) for p in chances), default=1.0)) < RECALL and k * (w + PER_PASS) <= most:
            k += max(1, k // 16)
        if recall >= RECALL and k * (w + PER_PASS) <= most:
            best, most = Plan(k, w, recall), k * (w + PER_PASS)
        if w >= min(nodes, WIDEST):
            return best or Plan(0, 0, 1.0, exact=True)
        w *= 2


class Forest:
    """A union-find that tells whether a link joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def sampled(nodes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """length -> unit vectors of a sample of nodes (node, v) that is the same for any partitioning."""
    widest = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * widest)) / max(count, 1))
    table = nodes.where(F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.xxhash64("v").alias("h"), "v").toArrow().sort_by("h")
    unit, lengths = unit_rows(table.column("v").to_pylist())
    return {int(n): unit[lengths == n, :n] for n in np.unique(lengths)}


def places(nodes: DataFrame, samples: dict[int, np.ndarray], passes: int, start: int = 0) -> DataFrame:
    """node, at: its place (pass, n) among all vectors sorted by key, for each of so many passes from start on."""
    ship(nodes.sparkSession)
    spark = nodes.sparkSession
    known = spark.sparkContext.broadcast({n: [Tree(x, n, seed) for seed in range(start, start + passes)] for n, x in samples.items()})

    def keyed(batches):
        trees = known.value
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                unit, lengths = unit_column(part.column(1))
                keys = np.zeros((passes, len(part)), np.int64)
                for n in np.unique(lengths):
                    of = trees.get(int(n)) or [Tree(np.zeros((0, int(n))), int(n), seed) for seed in range(start, start + passes)]
                    for seed in range(passes):
                        keys[seed, lengths == n] = of[seed].keys(unit[lengths == n, :n])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(start, start + passes, dtype=np.int32), len(part))), pa.array(np.tile(lengths, passes)), pa.array(keys.ravel()), *(pa.array(np.tile(part.column(i).to_numpy(), passes)) for i in (2, 0))], names=["pass", "length", "key", "h", "node"])

    def numbered(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(n, n + len(batch)))], names=["pass", "node", "part", "n"])
            n += len(batch)

    keys = nodes.select("node", "v", F.xxhash64("v")).mapInArrow(keyed, "pass int, length long, key long, h long, node long")
    order = ("pass", "length", "key", "h", "node")
    ordered = keys.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ordered = staged(ordered.mapInArrow(numbered, "pass int, node long, part int, n long"), "places")
    # Places go on from one part to the next; those of a pass needn't start at 0.
    starts, total = [], 0
    for part, count in sorted(tuple(r) for r in ordered.groupBy("part").count().collect()):
        starts.append((part, total))
        total += count
    first = spark.createDataFrame(starts, "part int, start long")
    found = ordered.join(F.broadcast(first), "part").select("node", F.struct("pass", (F.col("start") + F.col("n")).alias("n")).alias("at"))
    return found.groupBy("node").agg(F.collect_list("at").alias("at"))


def pass_links(nodes: DataFrame, placed: DataFrame, count: int, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """a, b of spanning forests of the links found among nodes (node, v) at most window places apart in some pass."""
    ship(nodes.sparkSession)
    block = min(max(16 * window, 2048), max(512, count // 16))

    def compared(batches):
        forest = Forest()
        ids, marks, rows, lengths = np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros((0, 0)), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                new, new_lengths = unit_column(part.column(1))
                new_marks = np.stack([part.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4)], axis=1)  # pass, block, place
                near = np.flatnonzero((marks[:, :2] == new_marks[0, :2]).all(1))[-window:]
                ids, marks, rows, lengths = ids[near], marks[near], rows[near], lengths[near]
                before, wide = len(ids), max(rows.shape[1], new.shape[1])
                rows, new = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (rows, new))
                ids, marks = np.concatenate([ids, part.column(0).to_numpy()]), np.concatenate([marks, new_marks])
                rows, lengths = np.concatenate([rows, new]), np.concatenate([lengths, new_lengths])
                own = np.flatnonzero(new_marks[:, 2] // block == new_marks[:, 1])
                i, j = np.nonzero((rows[before + own] @ rows.T >= threshold) & (lengths[before + own, None] == lengths))
                i = before + own[i]
                fits = (j < i) & (marks[i, :2] == marks[j, :2]).all(1) & (marks[i, 2] - marks[j, 2] <= window)
                found = [(a, b) for a, b in zip(ids[j[fits]].tolist(), ids[i[fits]].tolist()) if forest.join(a, b)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    spread = nodes.join(placed, "node").select("node", "v", F.explode("at").alias("at")).select("node", "v", "at.pass", F.col("at.n").alias("n"))
    spread = spread.withColumn("block", F.explode(F.expr(f"sequence(n div {block}, (n + {window}) div {block})")))
    ordered = spread.repartition(shuffle_width(nodes.sparkSession), "pass", "block").sortWithinPartitions("pass", "block", "n")
    return ordered.select("node", "v", "pass", "block", "n").mapInArrow(compared, "a long, b long")


def block_links(nodes: DataFrame, samples: dict[int, np.ndarray], count: int, threshold: float = THRESHOLD) -> DataFrame:
    """a, b of spanning forests of all links among nodes (node, v): blocks of the sorted order, pruned by centre and radius."""
    spark = nodes.sparkSession
    ship(spark)
    widest = max(samples, default=1)
    edge = max(min(max(LEAST_BLOCK, count // 32), 4096), -(-count // max(1, min(BLOCKS, CENTRE_BYTES // (8 * widest)))))
    placed = places(nodes, samples, 1).select("node", F.col("at")[0]["n"].alias("n"))
    blocks = staged(nodes.join(placed, "node").select("node", "v", (F.size("v") * (1 << 32) + F.expr(f"n div {edge}")).alias("block")), "blocks")

    def centred(table: pa.Table) -> pa.Table:
        unit, _ = unit_rows(table.column("v").to_pylist())
        mean = unit.mean(axis=0)
        mean = mean / norm if (norm := np.linalg.norm(mean)) > 1e-9 else unit[0]
        radius = float(np.arccos(np.clip((unit @ mean).min(), -1, 1)))
        return pa.table({"block": table.column("block").slice(0, 1), "centre": pa.array([mean.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    found = blocks.groupBy("block").applyInArrow(centred, "block long, centre array<double>, radius double").toArrow()  # BLOCKS rows
    ids, radii, of = found.column("block").to_numpy(), found.column("radius").to_numpy(), {}
    for n in np.unique(ids >> 32):
        at = np.flatnonzero(ids >> 32 == n)
        of[int(n)] = ids[at], np.array(found.column("centre").take(pa.array(at)).to_pylist()).reshape(len(at), int(n)), radii[at]
    known, reach = spark.sparkContext.broadcast(of), float(np.arccos(threshold)) + 1e-6

    def dealt(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                own = part.column(2).to_numpy()
                unit, lengths = unit_column(part.column(1))
                for n in np.unique(lengths):
                    here = np.flatnonzero(lengths == n)
                    names, centres, spans = known.value[int(n)]
                    near = np.arccos(np.clip(unit[here, :n] @ centres.T, -1, 1)) <= spans + reach
                    i, j = np.nonzero(near | (names == own[here, None]))
                    for k in range(0, len(i), 4096):
                        row, other = here[i[k : k + 4096]], names[j[k : k + 4096]]
                        taken, mine = part.take(pa.array(row)), own[row]
                        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(mine), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other))], names=["node", "v", "own", "lo", "hi"])

    def compared(table: pa.Table) -> pa.Table:
        unit, _ = unit_rows(table.column("v").to_pylist())
        own, node = table.column("own").to_numpy(), table.column("node").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        one, two, forest, out = np.flatnonzero(own == lo), np.flatnonzero(own == hi), Forest(), []
        for at in range(0, len(one), 512):
            some = one[at : at + 512]
            i, j = np.nonzero(unit[some] @ unit[two].T >= threshold)
            a, b = node[some[i]], node[two[j]]
            keep = a < b if lo == hi else a != b
            out += [(x, y) for x, y in zip(a[keep].tolist(), b[keep].tolist()) if forest.join(x, y)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    pairs = blocks.mapInArrow(dealt, f"node long, v {dict(nodes.dtypes)['v']}, own long, lo long, hi long").repartition(shuffle_width(spark), "lo", "hi")
    return pairs.groupBy("lo", "hi").applyInArrow(compared, "a long, b long")


def found_links(nodes: DataFrame, count: int, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """a, b of spanning forests of the links among nodes (node, v, staged), as their plan finds them; staged."""
    samples = sampled(nodes, count)
    known = sum(map(len, samples.values()))
    plans = [plan(x, round(count * len(x) / known), threshold, passes, window) for x in samples.values()]
    if any(p.exact for p in plans):
        return staged(block_links(nodes, samples, count, threshold), "links")
    passes, window = (max([least, *(getattr(p, name) for p in plans)]) for name, least in (("passes", passes), ("window", window)))
    rounds = [staged(pass_links(nodes, places(nodes, samples, min(ROUND, passes - start), start), count, threshold, window), "links") for start in range(0, passes, ROUND)]
    return reduce(DataFrame.union, rounds)


def link_counts(members: DataFrame, sizes: DataFrame, total: int, threshold: float = THRESHOLD) -> DataFrame:
    """node, n: the weights of all other nodes of its component that are linked with it.

    members: component, node, v, m (total rows, staged); sizes: component, size (staged). Every two blocks of a
    component are a group of their own, dealt by all three of its keys, so that a large component is many tasks' work.
    """
    ship(members.sparkSession)
    edge = F.least(F.greatest(F.ceil(F.col("size") / 16), F.lit(EDGE[0])), F.lit(EDGE[1]))
    sized = hot_join(members, sizes.select("component", "size", F.ceil(F.col("size") / edge).cast("int").alias("blocks")), "component", "size", total)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    paired = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "v", "m")
    paired = paired.repartition(shuffle_width(members.sparkSession), "component", "lo", "hi")

    def counted(table: pa.Table) -> pa.Table:
        unit, lengths = unit_rows(table.column("v").to_pylist())
        own, m, node = (table.column(c).to_numpy() for c in ("own", "m", "node"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        out = np.zeros(len(m), np.int64)
        one, two = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        for at in range(0, len(one), 1024):
            part = one[at : at + 1024]
            close = (unit[part] @ unit[two].T >= threshold) & (lengths[part, None] == lengths[two]) & (node[part, None] != node[two])
            out[part] += close @ m[two]
            if lo != hi:
                out[two] += m[part] @ close
        return pa.table({"node": node, "n": out})

    parts = paired.groupBy("component", "lo", "hi").applyInArrow(counted, "node long, n long")
    return parts.groupBy("node").agg(F.sum("n").alias("n"))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """id, n_links, component_id of each row."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.elementType.typeName() != "float":  # those are doubles as they are
        v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(finite, F.lit(False)), v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("m"))
    nodes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    count, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    found = found_links(nodes.select("node", "v"), count, threshold, passes, window)
    parts = components(found)
    members = staged(nodes.join(parts, "node").select("component", "node", "least_id", "v", "m"), "members")
    sizes = staged(members.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "sizes")
    linked = members.count()
    counts = staged(link_counts(members.select("component", "node", "v", "m"), sizes.select("component", "size"), linked, threshold), "counts")
    named = hot_join(members.select("component", "node"), sizes, "component", "size", linked).select("node", "component_id")
    known = nodes.join(named, "node", "left").join(counts, "node", "left")
    known = staged(known.select("v", "m", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "known")
    unstage(found, members, sizes, counts, nodes)
    linked = hot_join(rows.where("v is not null"), known, "v", "m", total).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone)


def op6_embedding_passes(spark, sf_dir):
    found = embedding_groups(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
