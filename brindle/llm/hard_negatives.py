"""Hard negatives by an orthogonal PCA rotation, with exact integer scores.

Components are scaled to integers, so scores are exact. An orthogonal rotation, whose leading axes hold most of a sample's
energy, leaves products as they are: the leading components' partial product, plus or minus the product of the norms of
what is left, holds the score between two bounds (Cauchy-Schwarz), with `slack` for the rounding of the rotation. A pair
is discarded as soon as its bounds rule it out, first on `LEAD[0]` of the components, then on `LEAD[1]`; the integer
product of the two rows decides about those that survive.

Anchors and rows meet in blocks: rows of one length (in the first step of one label too) are dealt to groups of at most
`ROWS`, anchors to groups of `ANCHORS`, and every two groups are a task's work of bounded size, whatever share one label
has. A task keeps the first `k` rows for each anchor, which also bound what can still enter; these are merged by anchor.
The first step finds positives (rows of the same label), the second, for each positive, the rows of other labels
with scores between `least` percent of its own score and that score itself.

The sample that the rotation is fitted on is bounded (`SAMPLE` rows, those whose contents hash lowest); it decides how
early pairs are discarded, never what is found. Every row is compared with every anchor of its length.

Defined results: rows with a null label or vector, or with null or non-finite components, take no part, and neither do
rows with a component so large (2^31 / sqrt(2 n) after scaling, n components) that scores might pass 63 bits. Rows of
different lengths aren't compared. A null id is never an anchor, and comes last among equal scores. Repeated rows and
ids are rows of their own; a row is no partner of itself. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .common import hot_join, load, staged, unstage

#: Rows and anchors of a task's two blocks, at most and on average; tables are cut into `CUTS` groups of rows at least.
ROWS, ANCHORS, CUTS, FEWEST = 1 << 16, 2048, 16, 1024
#: Shares of the components that bounds are computed from.
LEAD = (0.25, 0.5)
SAMPLE = 16384
#: The longest vectors that are rotated, and how many lengths (the commonest) are: rotations go with every task.
WIDEST, LENGTHS = 1024, 4
#: Rows and anchors that are multiplied at a time.
CHUNK = (4096, 256)
#: Pairs whose rows are laid side by side at a time.
PAIRS = 1 << 15
K, POSITIVES, LEAST = 5, 5, 80
NEVER = np.iinfo(np.int64).max


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of each component, x as a double; null unless all are finite and scores fit 63 bits."""
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * by))
    room = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(vector) * 2, F.lit(1)))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * by) < room))
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(numbers, lambda x: x.cast("int")))


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those first that hold most of the sample's energy."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(axes[:, ::-1])


class Turned:
    """Integer rows, their leading components after the rotation, and the norms of what is left."""

    def __init__(self, whole: np.ndarray, axes: np.ndarray | None):
        n = whole.shape[1]
        self.whole, self.cuts = whole, [max(1, min(n, round(n * share))) for share in LEAD] if n else [0, 0]
        doubles = whole.astype(np.float64)
        self.lead = doubles[:, : self.cuts[1]] if axes is None else doubles @ axes[:, : self.cuts[1]]
        energy = (doubles * doubles).sum(1)
        self.norm = np.sqrt(energy)
        # what is left is at most this, whatever rounding did to the difference
        self.rest = [np.sqrt(np.maximum(energy - (self.lead[:, :c] ** 2).sum(1), 0) + 1e-9 * energy) for c in self.cuts]


def slack(axes: np.ndarray | None, n: int) -> float:
    """A bound on the rounding error of a partial product, as a share of the product of the two norms."""
    if axes is None:
        return float(16 * (n + 1) * np.finfo(float).eps)
    return float(np.abs(axes.T @ axes - np.eye(n)).sum(axis=1).max(initial=0) * 2 + 16 * (n + 1) * np.finfo(float).eps)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows side by side."""
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


class Best:
    """The first k entries (score down, then id up, null ids last) of each of many lists."""

    def __init__(self, lists: int, k: int):
        self.k, self.lists = k, lists
        self.at = np.zeros((3, 0), np.int64)  # list, score, row
        self.worst = np.full(lists, -NEVER)  # the k-th score of each full list

    def put(self, lists: np.ndarray, scores: np.ndarray, rows: np.ndarray, rank: np.ndarray) -> None:
        """rank: the place of each row by id."""
        both = np.concatenate([self.at, np.stack([lists, scores, rows])], axis=1)
        both = both[:, np.lexsort((rank[both[2]], -both[1], both[0]))]
        starts = np.searchsorted(both[0], np.arange(self.lists))
        place = np.arange(both.shape[1]) - starts[both[0]]
        self.at = both[:, place < self.k]
        full = place[place < self.k] == self.k - 1
        self.worst[self.at[0, full]] = self.at[1, full]


def survivors(anchors: Turned, rows: Turned, some: np.ndarray, many: slice, least: np.ndarray, most: np.ndarray, valid: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the valid pairs that the bounds don't rule out of [least, most] of their anchor."""
    first, second = anchors.cuts
    norms = anchors.norm[some, None] * rows.norm[None, many] * error + 1e-6
    part = anchors.lead[some, :first] @ rows.lead[many, :first].T
    room = anchors.rest[0][some, None] * rows.rest[0][None, many] + norms
    i, j = np.nonzero(valid & (part + room >= least[:, None]) & (part - room <= most[:, None]))
    partial, found = part[i, j], []
    for at in range(0, len(i), PAIRS):  # rows side by side take far more than the matrix of their products
        n, k = i[at : at + PAIRS], j[at : at + PAIRS]
        a, r = some[n], k + many.start
        more = partial[at : at + PAIRS] + np.einsum("ij,ij->i", anchors.lead[a, first:second], rows.lead[r, first:second])
        room = anchors.rest[1][a] * rows.rest[1][r] + norms[n, k]
        stay = (more + room >= least[n]) & (more - room <= most[n])
        found.append((n[stay], r[stay], products(anchors.whole[a[stay]], rows.whole[r[stay]])))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), n).astype(np.int32)


def _group(table: pa.Table, axes: dict[int, np.ndarray]) -> tuple:
    """The anchors and the rows of a group: their numbers, ids, labels and Turned; rank of rows by id; axes' error."""
    n = table.column("n")[0].as_py()
    turn = axes.get(n)
    out = []
    for want in (True, False):
        part = table.filter(pa.compute.equal(table.column("is_anchor"), want))
        out += [part, part.column("row").to_numpy(), part.column("label").to_numpy(), Turned(_matrix(part.column("q"), n), turn)]
    ids = out[4].column("id")
    named, plain = pa.compute.is_valid(ids).to_numpy(), pa.compute.fill_null(ids, 0).to_numpy()
    rank = np.empty(len(plain), np.int64)
    rank[np.lexsort((out[5], plain, ~named))] = np.arange(len(plain))
    return *out, rank, slack(turn, n)


def _spread(rows: DataFrame, anchors: DataFrame, by: list[str], total: int) -> DataFrame:
    """Groups of rows and anchors that are equal in by: every block of one beside every block of the other.

    Blocks are numbered by hash and counted for each value of by, so that values without anchors cost nothing.
    """
    key = F.struct(*by)
    sizes = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("is_anchor"), 1)).alias("asked")).where("asked > 0")
    edge = F.least(F.greatest(F.ceil(F.col("size") / CUTS), F.lit(FEWEST)), F.lit(ROWS))
    sizes = staged(sizes.select("key", "size", F.ceil(F.col("size") / edge).cast("int").alias("row_blocks"), F.ceil(F.col("asked") / ANCHORS).cast("int").alias("anchor_blocks")), "sizes")
    block = lambda count: F.pmod(F.xxhash64("row"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    ask = hot_join(anchors.withColumn("key", key), sizes, "key", "size", total).withColumn("anchor_block", block("anchor_blocks")).withColumn("row_block", every("row_blocks"))
    tell = hot_join(rows.withColumn("key", key), sizes, "key", "size", total).withColumn("row_block", block("row_blocks")).withColumn("anchor_block", every("anchor_blocks"))
    columns = ["key", "anchor_block", "row_block", "n", "row", "id", "label", "q"]
    return ask.select(*columns, F.lit(True).alias("is_anchor"), "bounds").unionByName(tell.select(*columns, F.lit(False).alias("is_anchor"), F.lit(None).cast("array<bigint>").alias("bounds")))


def _merged(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The first k of each key, numbered from 1."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_of_label(rows: DataFrame, axes: dict[int, np.ndarray], total: int, k: int = POSITIVES) -> DataFrame:
    """row (an anchor), other, id, score, rank of the first k other rows of an anchor's label."""

    def compared(table: pa.Table) -> pa.Table:
        asked, own, _, anchors, told, numbers, _, others, rank, error = _group(table, axes)
        best = Best(len(own), k)
        for at in range(0, len(own), CHUNK[1]):
            some = np.arange(at, min(at + CHUNK[1], len(own)))
            for start in range(0, len(numbers), CHUNK[0]):
                many = slice(start, min(start + CHUNK[0], len(numbers)))
                valid = own[some, None] != numbers[None, many]
                i, r, score = survivors(anchors, others, some, many, best.worst[some], np.full(len(some), NEVER), valid, error)
                best.put(some[i], score, r, rank)
        lists, score, r = best.at
        return pa.table({"row": own[lists], "other": numbers[r], "id": told.column("id").take(pa.array(r)), "score": score})

    ship(rows.sparkSession)
    anchors = rows.where("is_anchor").withColumn("bounds", F.lit(None).cast("array<bigint>"))
    groups = _spread(rows, anchors, ["n", "label"], total).groupBy("key", "anchor_block", "row_block")
    return _merged(groups.applyInArrow(compared, "row long, other long, id long, score long"), ["row"], k)


def first_between(rows: DataFrame, anchors: DataFrame, axes: dict[int, np.ndarray], total: int, k: int = K, least: int = LEAST) -> DataFrame:
    """row, place, other, id, score, rank: the first k rows of other labels for each place (from 0) of an anchor's bounds.

    anchors: rows with bounds, the scores of their positives in order; a row's score is to lie between least percent of
    such a score and the score itself.
    """

    def compared(table: pa.Table) -> pa.Table:
        asked, own, own_label, anchors, told, numbers, labels, others, rank, error = _group(table, axes)
        bounds = asked.column("bounds").to_pylist()
        wide = max(map(len, bounds), default=0)
        most = np.array([[*b, *[-NEVER] * (wide - len(b))] for b in bounds], np.int64).reshape(len(own), wide)
        known = np.array([[True] * len(b) + [False] * (wide - len(b)) for b in bounds], bool).reshape(len(own), wide)
        low = -(-most * least // 100)
        low = np.where(known & (low <= most), low, NEVER)
        best = Best(len(own) * wide, k)
        for at in range(0, len(own), CHUNK[1]):
            some = np.arange(at, min(at + CHUNK[1], len(own)))
            for start in range(0, len(numbers), CHUNK[0]):
                many = slice(start, min(start + CHUNK[0], len(numbers)))
                wanted = np.maximum(low, best.worst.reshape(len(own), wide))[some].min(axis=1, initial=NEVER)
                valid = own_label[some, None] != labels[None, many]
                top = np.where(low[some] < NEVER, most[some], -NEVER).max(axis=1, initial=-NEVER)
                i, r, score = survivors(anchors, others, some, many, wanted, top, valid, error)
                a = some[i]
                for p in range(wide):
                    fits = (score >= low[a, p]) & (score <= most[a, p])
                    best.put(a[fits] * wide + p, score[fits], r[fits], rank)
        lists, score, r = best.at
        return pa.table({"row": own[lists // max(wide, 1)], "place": lists % max(wide, 1), "other": numbers[r], "id": told.column("id").take(pa.array(r)), "score": score})

    ship(rows.sparkSession)
    groups = _spread(rows, anchors, ["n"], total).groupBy("key", "anchor_block", "row_block")
    return _merged(groups.applyInArrow(compared, "row long, place long, other long, id long, score long"), ["row", "place"], k)


def hard_negatives(rows: DataFrame, k: int = K, positives: int = POSITIVES, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the table's anchors.

    rows: id, label, q (array<int>), is_anchor.
    """
    spark = rows.sparkSession
    ship(spark)
    numbered = rows.where("q is not null and label is not null").select("id", F.col("label").cast("long").alias("label"), "q", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), F.size("q").alias("n"))
    table = staged(numbered.withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = {r.n: r.c for r in table.groupBy("n").agg(F.count(F.lit(1)).alias("c")).where(F.col("n").between(1, WIDEST)).orderBy(F.desc("c"), "n").limit(LENGTHS).collect()}
    axes = {}
    for n, count in counts.items():  # vectors of other lengths are compared by their components as they are
        share = min(1.0, SAMPLE / count)
        sample = table.where((F.col("n") == n) & (F.pmod(F.xxhash64("q", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(2 * SAMPLE).select("q").toArrow()
        if len(sample):
            axes[n] = rotation(_matrix(sample.column("q"), n).astype(np.float64))
    total = table.count()
    found = staged(first_of_label(table, axes, total, positives), "positives")
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("found"))  # of `positives` at most
    asked = staged(table.where("is_anchor").join(lists, "row").withColumn("bounds", F.col("found.score")), "anchors")
    between = first_between(table, asked.drop("found"), axes, total, k, least)
    named = between.join(asked.select("row", F.col("id").alias("anchor_id"), "found"), "row").withColumn("positive", F.expr("found[cast(place as int)]"))
    out = named.select("anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
    out = staged(out, "negatives")
    unstage(table, found, asked)
    return out


def mined_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, moved: int = 7, labels: int = 10) -> DataFrame:
    """id, label, q, is_anchor: ids divisible by moved get the next label, those divisible by every are anchors."""
    vec = F.col(id_col).cast("long")
    label = F.when(vec % moved == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    return embeddings.select(vec.alias("id"), label.alias("label"), scaled(F.col(vector_col)).alias("q"), (vec % every == 0).alias("is_anchor"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives(mined_rows(load(spark, sf_dir, "embeddings")))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.row, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.row <> b.row AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
     p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, id, other) AS place FROM s WHERE same) WHERE place <= 5),
     n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.id, s.other) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
           FROM p JOIN s ON s.row = p.row AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""
