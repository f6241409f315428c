"""Mixing sources to target weights.

Each source's documents are laid end to end and cut into blocks of `block_words` words. A source's target gives the
number of output slots that it fills. The slots are dealt to runs of `RUN_SHARDS` output shards: each run gets its share
of every source's slots to within one (a source's places in that rhythm begin at a pseudorandom phase), and within a
run the shards' counts are multinomial draws conditioned on the run's, down a binary tree of shards seeded by node. The
j-th slot of a source takes the block that a pseudorandom permutation of the source's block numbers (a Feistel network
with cycle walking) gives for j, so each pass over a source takes each block once, and a source with target t passes
over itself at most ceil(t / size) times. Slots and blocks meet in an equi-join by source and block number, which no hot
source can skew.

Places within a source come from sums in two levels (hash buckets of a source, then classes of equal rows of a bucket;
the copies of a class are laid out one after the other and spread before they are written out), so that neither a
source nor a repeated row with a third of all rows is one task's work. Sources are rows of a table: they are numbered,
weighed and dealt in Spark, whatever their number, and the same way at every size.

Defined results: a null text has no words; null sources are one source, last in order; documents without words are
there with taken 0; repeated rows are documents of their own; null ids are ordinary; an empty table gives an empty
result. Reruns agree, however the rows are partitioned; of repeated rows that differ in other columns alone, the order
of a hash of all columns tells which is which.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .common import WORD, load, shuffle_width, staged

WEIGHTS = (5, 2, 1)
MOST = 3.0
BLOCK_WORDS = 64
#: Slots of an output shard, and shards of a run: a run's slots are one group's work and below 2^18.
SLOTS = 4096
RUN_SHARDS = 64
#: Copies of a row that are written out together.
COPIES = 4096
_M = 0xFFFFFFFFFFFFFFFF


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of j (each below n) under the pseudorandom permutation of [0, n) that key names."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for turn in range(4):
            mixed = (right + np.uint64((key * 4 + turn) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (mixed ^ mixed >> np.uint64(29)) & mask
        return left << shift | right

    with np.errstate(over="ignore"):
        x = network(j.astype(np.uint64))
        while (out := x >= n).any():
            x[out] = network(x[out])
    return x.astype(np.int64)


def shard_counts(totals: np.ndarray, shards: int, seed: list[int]):
    """(shard, sources, counts, before) of each shard: the slots that it has of the sources with any, and how many of
    theirs come in shards before it.

    Shards have equally many slots, but for one at most; over all shards a source has its total.
    """
    all_slots = int(totals.sum())
    edge = lambda k: all_slots * k // shards
    some = np.flatnonzero(totals)
    stack = [(0, shards, some, totals[some].astype(np.int64), np.zeros(len(some), np.int64))]
    while stack:
        lo, hi, some, left, before = stack.pop()
        if hi - lo == 1:
            yield lo, some, left, before
            continue
        mid = (lo + hi) // 2
        drawn = np.random.default_rng([*seed, lo, hi]).multivariate_hypergeometric(left, edge(mid) - edge(lo), method="marginals")
        one, two = drawn > 0, left > drawn
        stack.append((mid, hi, some[two], (left - drawn)[two], (before + drawn)[two]))
        stack.append((lo, mid, some[one], drawn[one], before[one]))


def in_order(df: DataFrame, *order) -> DataFrame:
    """df with `place`, its rows' numbers in this order, without all of them in one task."""
    spark = df.sparkSession
    at = staged(df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    starts = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))  # one row a task
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", before.alias("before"))
    return at.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def plan_of(sizes: DataFrame, weights=WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, place, source_size, target, blocks, slots of each source, staged. sizes: source, source_size.

    Targets go by weight; those above most times their source's size stop there, and the excess is reshared by weight
    until none is above. A round is one aggregation; the share of a unit of weight only rises, so rounds end.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    at = staged(in_order(sizes, F.col("source").isNull(), F.col("source")).withColumn("w", weight), "sources")
    total, every = at.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    left, open_, stopped = float(total), every, 0
    while open_:
        over = F.lit(left) * F.col("w") / F.lit(open_) > F.lit(most) * F.col("source_size")
        n, held, share = at.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == stopped:
            break
        left, open_, stopped = total - most * held, share, n
    open_ = open_ or 1.0
    target = F.least(F.lit(left) * F.col("w") / F.lit(open_), F.lit(most) * F.col("source_size"))
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    found = at.select("source", "place", "source_size", target.alias("target"), blocks.alias("blocks"))
    # a source's last block may be short, so slots are counted by the mean length of its blocks
    slots = F.least(F.floor(F.lit(most) * F.col("blocks")), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    return staged(found.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0)).cast("long")), "plan")


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): id, source, digest, size, copy, start (the words of its source before it), place, source_size,
    target of each row, staged; and the plan of its sources."""
    ship(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("digest"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = staged(sized, "sized")
    classes = sized.groupBy("id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies"))
    buckets = 1 << max(4, min(16, math.ceil(math.log2(max(1, sized.count()) / 1024 + 1))))
    dealt = classes.withColumn("bucket", F.pmod(F.xxhash64("id", "digest"), F.lit(buckets)))
    words = F.col("size") * F.col("copies")
    sums = staged(dealt.groupBy("source", "bucket").agg(F.sum(words).alias("n")), "sums")
    known = plan_of(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **plan)
    base = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("base", F.coalesce(base, F.lit(0))).join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "place", "source_size", "target")
    within = F.sum(words).over(Window.partitionBy("source", "bucket").orderBy("id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = dealt.withColumn("within", F.coalesce(within, F.lit(0)))
    found = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    found = found.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    found = found.repartition(shuffle_width(docs.sparkSession), "source", "id", "digest", "chunk")
    found = found.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {COPIES}, least(copies, (chunk + 1) * {COPIES}) - 1)")))
    start = F.col("base") + F.col("within") + F.col("copy") * F.col("size")
    return staged(found.select("id", "source", "digest", "size", "copy", start.alias("start"), "place", "source_size", "target"), "placed"), known


def slots_of(plan: DataFrame, seed: int = 1, slots: int = SLOTS) -> DataFrame:
    """shard, slot, place (of the source), block, turn (the pass over the source) of every output slot."""
    ship(plan.sparkSession)
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    runs = max(1, -(-total // (slots * RUN_SHARDS)))
    # Of a source's k slots, floor((r k + phase) / runs) come before run r; with fewer slots than runs, only k runs have one.
    named = plan.where("slots > 0").withColumn("phase", F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(runs)))
    spread = named.withColumn("i", F.explode(F.expr(f"sequence(0L, least(slots, {runs}L) - 1)")))
    run = F.expr(f"if(slots >= {runs}L, i, ((i + 1) * {runs}L - phase + slots - 1) div slots - 1)")
    spread = spread.withColumn("run", run)
    spread = spread.withColumn("before", F.expr(f"(run * slots + phase) div {runs}L")).withColumn("n", F.expr(f"((run + 1) * slots + phase) div {runs}L") - F.col("before"))

    def dealt(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        run = table.column("run")[0].as_py()
        place, blocks, totals, first = (table.column(c).to_numpy() for c in ("place", "blocks", "n", "before"))
        shards = max(1, -(-int(totals.sum()) // slots))
        parts = []
        for shard, some, counts, before in shard_counts(totals, shards, [seed, run]):
            at = np.repeat(np.arange(len(some)), counts)
            j = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + (first[some] + before)[at]
            order = np.random.default_rng([seed, run, shards, shard]).permutation(len(at))
            parts.append((np.full(len(at), run * 4096 + shard), order, some[at], j))
        shard, slot, source, j = map(np.concatenate, zip(*parts))
        turn, block = j // blocks[source], np.zeros(len(j), np.int64)
        order = np.lexsort((turn, source))
        edges = np.flatnonzero((np.diff(source[order], prepend=-1) != 0) | (np.diff(turn[order], prepend=-1) != 0))
        for a, b in zip(edges, np.r_[edges[1:], len(order)]):
            some = order[a:b]
            s, t = int(source[some[0]]), int(turn[some[0]])
            block[some] = permuted(j[some] % blocks[s], int(blocks[s]), ((seed * 1_000_003 + int(place[s])) * 1_000_003 + t) & _M)
        return pa.table({"shard": shard, "slot": slot, "place": place[source], "block": block, "turn": turn})

    # few bytes make many slots, so adaptive execution is kept from merging the runs' tasks
    dealt_out = spread.select("run", "place", "blocks", "n", "before").repartition(min(runs, shuffle_width(plan.sparkSession)), "run")
    return dealt_out.groupBy("run").applyInArrow(dealt, "shard long, slot long, place long, block long, turn long")


def segments_of(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """place, block and the words first to last (exclusive, within the document) that each document has in a block."""
    L = F.lit(block_words)
    spread = rows.where("size > 0").select("id", "digest", "place", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    first = F.greatest(F.col("block") * L - F.col("start"), F.lit(0))
    return spread.select("id", "digest", "place", "start", "block", first.alias("first"), F.least((F.col("block") + 1) * L - F.col("start"), F.col("size")).alias("last"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = 1):
    """(rows, plan, mixed): documents with their places, the sources' plan, and for every output slot the document
    spans that its block consists of: shard, slot, turn, place, block, id, digest, start, first, last."""
    rows, plan = placed(docs, id_col, text_col, source_col, weights=weights, most=most, block_words=block_words)
    # both sides grow with the corpus; without the hint the slots would be taken for as small as the plan they come from
    mixed = slots_of(plan, seed).hint("merge").join(segments_of(rows, block_words), ["place", "block"])
    return rows, plan, mixed


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars", **how) -> DataFrame:
    """The mix as documents, with docs' columns: a document once for each pass that takes words of it.

    A pass that takes all of a document's words gives its text as it is; one that takes some gives the spans that it
    takes, joined by single spaces. Documents of which no word is taken are not in the mix. count_col, if docs has
    it, is the new text's length in code points. A repeated row is in the mix as often as its copies are taken.
    """
    rows, _, mixed = mix(docs, id_col, text_col, source_col, **how)
    spans = mixed.groupBy("place", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum(F.col("last") - F.col("first")).alias("n"))
    found = spans.join(rows.where("size > 0"), ["place", "start"])
    found = found.select("source", "id", "digest", "copy", F.when(F.col("n") < F.col("size"), F.col("spans")).alias("spans"))
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), F.xxhash64(text_col).alias("d"), F.xxhash64(*plain).alias("h"))
    named = named.withColumn("k", F.row_number().over(Window.partitionBy("s", "i", "d").orderBy("h")) - 1)
    joined = named.join(found, F.col("i").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("copy")))
    last = "spans" + "_" * max(map(len, docs.columns))
    out = joined.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("spans").alias(last))
    return _cut(out, docs, text_col, count_col)


def _cut(rows: DataFrame, docs: DataFrame, text_col: str, count_col: str) -> DataFrame:
    names = docs.columns
    at, word = names.index(text_col), re.compile(WORD)

    def text_of(text: str, spans) -> str:
        if spans is None:
            return text
        words = word.findall(text)
        return " ".join(w for s in spans for w in words[s["first"] : s["last"]])

    def of(batches):
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                columns = list(part.columns[:-1])
                columns[at] = pa.array(list(map(text_of, columns[at].to_pylist(), part.columns[-1].to_pylist())), columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(of, docs.schema)
    return out.withColumn(count_col, F.char_length(text_col).cast(docs.schema[count_col].dataType)) if count_col in names else out


def op4_source_mix(spark, sf_dir):
    rows, _, mixed = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = mixed.groupBy("place", "start").agg(F.sum(F.col("last") - F.col("first")).cast("long").alias("taken"))
    named = F.col("id").alias("doc_id"), "size", "source_size", "target"
    full = rows.where("size > 0").join(taken, ["place", "start"], "left").select(*named, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return full.union(rows.where("size = 0").select(*named, F.lit(0).cast("long").alias("taken")))
