"""Exact deduplication over an extendible-hash index held in shared files, in DataFrame operations alone.

The 64-bit key of a document is the XXH64 of its normalised text, and its leading bits are a place in the directory. The
directory starts with one bucket and doubles: a bucket with more than `capacity` keys is split by one more leading bit,
again and again, up to `depth` bits. It is made from the keys alone, before any text moves; the doubling is computed as
a set (a leaf's local depth is the number of its overfull ancestors). Buckets are contiguous ranges of keys, and runs
of buckets with about equally many rows belong to one owner.

Every row looks its bucket and owner up in the directory and goes to the owner's task, which orders its buckets by key
and chains the texts that share a key: it compares their bytes, numbers them, and finds each one's largest id and number
of rows. What it finds is written to the index's pages in the shared folder, and the result is read from there. So each
text crosses the network once.

A key with more than 1 / 4,096 of all rows would make its owner slow. There are fewer than 4,096 such keys; their rows
are first combined by (key, bytes) in the tasks that read them, owners chain the combined texts only, and the rows look
their text up on the owners' pages by (key, bytes).

Bounds: the directory has at most 2^`MAX_DEPTH` leaves, whatever the table's size (capacity grows with it), which is
what is broadcast.

Defined results: a null text counts as empty; empty texts are equal to one another; of equal texts the largest
doc_id stays (a null id only if there is no other); a row that is repeated whole is kept as often as it is there.
An empty table gives an empty result. Columns of docs that are named as results are (keep_id, group_size, kept,
text_sha256) give way to these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .common import HOT_SHARE, ascii_lower, load, shuffle_width, staged, unstage

CAPACITY = 500
#: Bits of a leaf: 2^18 leaves take about 16 MB where they are broadcast.
MAX_DEPTH = 18
#: Owners to a task, so that tasks get about equal shares.
OWNERS = 8
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: An owner's chain, and a text in it.
CHAIN = ("owner", "bucket", "key")
TEXT = (*CHAIN, "body")


def key_of(body: Column, key_bits: int = 64) -> Column:
    """The leading key_bits of a text's XXH64. Fewer than 64 serve tests of colliding keys."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 64 - key_bits), 64 - key_bits) if key_bits < 64 else F.xxhash64(body)


def directory_of(keys: DataFrame, capacity: int, depth: int, owners: int, total: int) -> DataFrame:
    """leaf, local_depth, bucket, owner of each leaf (the leading depth bits of a key). keys: key, n (its rows)."""
    leaves = keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("leaf")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))
    ancestors = leaves.select("leaf", "keys", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
    ancestors = ancestors.withColumn("prefix", F.expr(f"shiftrightunsigned(leaf, {depth} - level)"))
    overfull = ancestors.groupBy("level", "prefix").agg(F.sum("keys").alias("m")).where(F.col("m") > capacity).select("level", "prefix")
    # an overfull ancestor has more than capacity keys, so a level has fewer of them than 2^MAX_DEPTH
    depths = ancestors.join(F.broadcast(overfull), ["level", "prefix"], "left_semi").groupBy("leaf").agg(F.count(F.lit(1)).cast("int").alias("local_depth"))
    found = leaves.join(depths, "leaf", "left").select("leaf", "rows", F.coalesce("local_depth", F.lit(0)).alias("local_depth"))
    found = found.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(leaf, {depth} - local_depth), {depth} - local_depth)"))
    before = F.sum("rows").over(Window.orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1))  # one row a leaf: bounded
    return found.withColumn("before", F.coalesce(before, F.lit(0))).select("leaf", "local_depth", "bucket", F.expr(f"cast(before * {owners} div {max(1, total)} as int)").alias("owner"))


def body_of(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def chained(owned: DataFrame, rows: Column, largest: Column) -> DataFrame:
    """owned (with the columns of TEXT) and keep_id, group_size, chain_pos, text_sha256, as its owner finds them."""
    equal, chain = Window.partitionBy(*TEXT), Window.partitionBy(*CHAIN).orderBy("body")
    found = owned.withColumn("keep_id", F.max(largest).over(equal)).withColumn("group_size", F.sum(rows).over(equal))
    return found.withColumn("chain_pos", F.dense_rank().over(chain)).withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = 64, hot_share: float = HOT_SHARE) -> DataFrame:
    """The index's pages, one row a row of docs: bucket, local_depth, key, chain_pos, keep_id, group_size, text_sha256 and
    row (a struct of the columns named, or all)."""
    spark = docs.sparkSession
    ship(spark)
    columns = columns or docs.columns
    text = F.col(f"row.`{text_col}`") if text_col in columns else F.col("text")  # a text travels once
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), *([] if text_col in columns else [F.col(text_col).alias("text")])).withColumn("key", key_of(body_of(text), key_bits))
    keys = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    n_keys, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = max(capacity, n_keys >> (max_depth - 2))
    depth = max(1, min(max_depth, math.ceil(math.log2(max(2, n_keys / capacity))) + 4))
    tasks = shuffle_width(spark)
    directory = staged(directory_of(keys, capacity, depth, OWNERS * tasks, total), "directory")
    hot = F.broadcast(keys.where(F.col("n") > max(1, int(total * hot_share))).select("key"))
    known = F.broadcast(directory)

    def looked_up(some: DataFrame) -> DataFrame:
        return some.withColumn("leaf", F.shiftrightunsigned("key", 64 - depth)).join(known, "leaf").drop("leaf")

    page = ["bucket", "local_depth", "key", "chain_pos", "keep_id", "group_size", "text_sha256", "row"]
    own = looked_up(rows.join(hot, "key", "left_anti")).repartition(tasks, "owner").withColumn("body", body_of(text))
    found = chained(own, F.lit(1).cast("long"), F.col("id")).select(*page)

    shared = staged(looked_up(rows.join(hot, "key")), "hot")
    bodies = shared.withColumn("body", body_of(text))
    combined = bodies.groupBy(*CHAIN, "body").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("rows"))
    chains = chained(combined, F.col("rows"), F.col("largest")).withColumn("length", F.max("chain_pos").over(Window.partitionBy(*CHAIN)))
    chains = staged(chains.select("key", "body", "length", "chain_pos", "keep_id", "group_size", "text_sha256"), "chains")
    # The rows of a chain of one text have that text; there are as few of these as hot keys. Longer ones compare bytes.
    found = found.unionByName(shared.join(F.broadcast(chains.where("length = 1").drop("body")), "key").select(*page))
    found = found.unionByName(bodies.join(chains.where("length > 1"), ["key", "body"]).select(*page))
    found = staged(found, "pages")
    unstage(keys, directory, shared, chains)
    return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, **index) -> DataFrame:
    """The columns of docs (those named, or all), and keep_id, group_size, kept, text_sha256 of each row."""
    named = columns or docs.columns
    pages = build_index(docs, id_col, text_col, sorted({*named, id_col}, key=docs.columns.index), **index)
    kept = F.col(f"row.`{id_col}`").eqNullSafe(F.col("keep_id")).alias("kept")
    return pages.select(*(F.col(f"row.`{c}`").alias(c) for c in named if c not in RESULTS), "keep_id", "group_size", kept, "text_sha256")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(load(spark, sf_dir, "documents"), columns=["doc_id"])


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
