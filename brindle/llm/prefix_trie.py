"""The trie of conversation prefixes by prefix-doubling names.

A name is a number for what a run of turns says. Turns are named by their content; then blocks of 2, 4, 8, ... turns by
the names of their halves, in as many rounds as the longest conversation has doublings: each round names the distinct
pairs densely, from 0 on, and joins the names back to the blocks. Blocks are aligned, so a round has half the rows of
the one before it. The first d turns of a conversation are the blocks of d's binary digits, the largest first, and the
names of these, at most one a digit, are the key of a prefix. Equal keys are one node.

Sums over subtrees need no walk of the tree. A node is led by the smallest conversation that passes through it. Where a
conversation leads a node it leads all below on its own path, so it leads its turns from some depth `first` on, or none;
every node is led once. Sums over the nodes of a subtree are therefore sums over the conversations through its top: of
the bytes that each doesn't lead, of one for each that ends in a leaf, of one for each that branches off.

Hot names, prefixes and conversations: grouping is by sums and minima, which combine where rows are read; joins on
names go by `hot_join`, and blocks of more than `PIECE` turns are spread in pieces. The ids that end at one node may be
a third of all: they are sorted by range and joined into texts of up to `RUN_IDS` ids, and one task hashes these texts
of a node in order (SHA-256 has no parallel form) without holding them.

Defined results: rows with a null conversation belong to none; a null role or text is empty; turns that tie (null or
equal numbers) go by the SHA-256 of role and text, and stay as often as they are there; a conversation that is left
without turns counts at the root; an empty table gives an empty trie. Turns are equal if those digests are. Extra columns
aren't read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import ship
from .common import hot_join, load, shuffle_width, staged, unstage

#: Prefixes that one row of a block is spread to; longer blocks are cut first.
PIECE = 1 << 16
RUN_IDS = 4096
#: How many turns of another conversation may come first, and of how many neighbours.
HEAD, NEIGHBOURS = 9, 5


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), digest (of role and text), bytes (of the text) of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(rows, "conv", ["turn", "digest"], "pos").select("conv", "pos", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, len, digest, bytes of the rebuilt conversations' turns; conv, len of each conversation), not staged.

    Conversation c gets the first h turns of conversation c - c % 5, then its own after its first h; h = crc32(c) % 9.
    turns: staged, as turns_of gives them.
    """
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    base = turns.where((F.col("conv") % NEIGHBOURS == 0) & (F.col("pos") < HEAD - 1))
    heads = base.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    asked = own.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % NEIGHBOURS).alias("base"))
    known = asked.join(heads, "base", "left").withColumn("head", F.slice("head", F.lit(1), F.col("h").cast("int")))
    k = F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).cast("long")
    convs = staged(known.withColumn("k", k).select("conv", "own", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"), "head"), "convs")
    total = turns.count()
    tails = hot_join(turns.withColumnRenamed("pos", "at"), convs.select("conv", "own", "h", "k", "len"), "conv", "own", total).where("at >= h")
    tails = tails.select("conv", (F.col("k") + F.col("at") - F.col("h")).alias("pos"), "len", "digest", "bytes")
    front = convs.select("conv", "len", F.posexplode("head").alias("pos", "t")).select("conv", F.col("pos").cast("long").alias("pos"), "len", "t.digest", "t.bytes")
    return front.unionByName(tails), convs.select("conv", "len")


def dense_names(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, n (rows of it), name (0, 1, ...)) of each distinct key, and the number of rows. A row a task goes to the driver."""
    spark = rows.sparkSession
    counted = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.monotonically_increasing_id()), "names")
    parts = counted.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).collect()
    starts, total = [], 0
    for part, keys, _ in sorted(map(tuple, parts)):
        starts.append((part, total))
        total += keys
    first = spark.createDataFrame(starts, "part long, start long")
    named = counted.join(F.broadcast(first), F.shiftright("at", 33) == F.col("part"))
    return named.select(key, "n", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("name")), sum(r.rows for r in parts)


def named_blocks(turns: DataFrame) -> list[DataFrame]:
    """A staged table for each power of two: conv, len, j (the block's number), name, bytes. turns: staged, as rebuilt gives them."""
    rows, levels = turns.select("conv", "len", F.col("pos").alias("j"), F.col("digest").alias("key"), "bytes"), []
    while True:
        names, total = dense_names(rows, "key")
        if not total:
            return levels
        found = hot_join(rows, names, "key", "n", total).select("conv", "len", "j", "name", "bytes")
        levels.append(staged(found, "blocks"))
        # blocks whose two halves are there: a group has two rows at most
        even = F.col("j") % 2 == 0
        pairs = levels[-1].groupBy("conv", "len", F.expr("j div 2").alias("half")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"), F.sum("bytes").alias("bytes"))
        rows = pairs.where("a is not null and b is not null").select("conv", "len", F.col("half").alias("j"), F.struct("a", "b").alias("key"), "bytes")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, len, d, key, upto (bytes of the first d turns), last (bytes of the d-th) for d from 0 to len, staged."""
    levels = named_blocks(turns)
    spread = []
    for k, blocks in enumerate(levels):
        # block j of 2^k turns stands in the prefixes d with d >> k = j + 1, where j is even
        start = (F.col("j") + 1) * (1 << k)
        if k == 0:
            even = F.col("j") % 2 == 0
            spread.append(blocks.select("conv", "len", (F.col("j") + 1).alias("d"), F.lit(k).alias("k"), F.when(even, F.col("name")).alias("name"), F.when(even, F.col("bytes")).alias("bytes"), F.col("bytes").alias("last")))
            continue
        rows = blocks.where("j % 2 = 0").select("conv", "len", "name", "bytes", start.alias("from"), F.least(start + (1 << k) - 1, "len").alias("to"))
        if 1 << k > PIECE:
            cut = rows.withColumn("piece", F.explode(F.expr(f"sequence(from, to, {PIECE})"))).repartition("conv", "piece")
            rows = cut.withColumn("from", F.col("piece")).withColumn("to", F.least(F.col("piece") + PIECE - 1, "to")).drop("piece")
        spread.append(rows.select("conv", "len", F.explode(F.sequence("from", "to")).alias("d"), F.lit(k).alias("k"), "name", "bytes", F.lit(None).cast("long").alias("last")))
    named = F.when(F.col("name").isNotNull(), F.struct((-F.col("k")).alias("k"), "name"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["name"].cast("string")), ".")
    root = convs.select("conv", "len", F.lit(0).cast("long").alias("d"), F.lit("0:").alias("key"), F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("last"))
    if not levels:
        return staged(root, "prefixes")
    grouped = reduce(DataFrame.unionByName, spread).groupBy("conv", "len", "d").agg(names.alias("names"), F.sum("bytes").alias("upto"), F.max("last").alias("last"))
    found = staged(root.unionByName(grouped.select("conv", "len", "d", F.concat(F.col("d").cast("string"), F.lit(":"), "names").alias("key"), "upto", "last")), "prefixes")
    unstage(*levels)
    return found


def hashed_ends(ends: DataFrame) -> DataFrame:
    """key, sha: the SHA-256 of a key's ids in order, comma-joined. ends: key, conv."""
    width = shuffle_width(ends.sparkSession)

    def joined(batches):
        key, first, ids = None, None, []
        for batch in batches:
            out = []
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if k != key or len(ids) == RUN_IDS:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids = k, c, []
                ids.append(str(c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["key", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["key", "first", "ids"])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "sha"])

    texts = ends.select("key", "conv").repartitionByRange(width, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(joined, "key string, first long, ids string")
    return texts.repartition(width, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, sha string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node: conv_id (its leader), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, pos, len, digest, bytes; convs: conv, len of each conversation; both staged.
    """
    ship(turns.sparkSession)
    rows = prefixes(turns, convs)
    before = (F.col("upto") - F.col("last")).alias("before")
    nodes = staged(rows.groupBy("key", "d").agg(F.min("conv").alias("leader"), F.count(F.lit(1)).alias("n"), F.max("len").alias("longest"), F.max(before).alias("before")), "nodes")
    leads = nodes.groupBy(F.col("leader").alias("conv")).agg(F.min(F.struct(F.col("d").alias("first"), "before")).alias("top"), F.max((F.col("longest") == F.col("d")).cast("long")).alias("leaf"))
    whole = rows.where("d = len").select("conv", F.col("upto").alias("all"))
    # one row a conversation: first (null: it leads nothing), unled (bytes above that), leaf
    led = convs.join(leads, "conv", "left").join(whole, "conv").select("conv", "len", (F.col("len") + 1).alias("rows"), F.col("top.first").alias("first"), F.coalesce("top.before", "all").alias("unled"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    led = staged(led, "led")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = hot_join(rows.drop("len"), led, "conv", "rows", total)

    first, d = F.col("first"), F.col("d")
    saved = F.when(first.isNull() | (d < first), F.col("unled") - (F.col("upto") - F.col("last"))).otherwise(0)
    branches = F.when(first - 1 == d, 1).otherwise(0)
    goes_on = F.when((first <= d) & (F.col("len") > d), 1).otherwise(0)
    sums = joined.groupBy("key", "d").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(branches + goes_on).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"), F.min(F.when(first <= d, first)).alias("first"))
    # the parent of a node is led by the same conversation, but where that one branches off
    tops = joined.where(first - 1 == d).select("conv", "key")
    over = hot_join(tops, nodes.select("key", "n", F.col("leader").alias("parent")), "key", "n", total).select(F.col("conv").alias("conv_id"), "parent")
    ends = hashed_ends(rows.where("d = len").select("key", "conv"))
    found = sums.join(ends, "key", "left").join(over, "conv_id", "left")
    parent = F.when(d == 0, F.lit(None).cast("long")).when(d > first, F.col("conv_id")).otherwise(F.col("parent"))
    sha = F.coalesce("sha", F.sha2(F.lit(b""), 256))
    whole_numbers = [F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return found.select("conv_id", d.cast("long").alias("depth"), parent.alias("parent_conv_id"), *whole_numbers, sha.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **columns) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    ship(conversations.sparkSession)
    turns = staged(turns_of(conversations, **columns), "turns")
    found, convs = rebuilt(turns)
    return trie(staged(found, "rebuilt"), staged(convs, "lengths"))


def op13_prefix_trie(spark, sf_dir):
    return conversation_trie(load(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     h AS (SELECT c, own, (SELECT crc FROM (SELECT list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(CAST(c AS VARCHAR)) * 8), lambda i: i::UBIGINT)), lambda a, i: CASE WHEN i % 8 = 0 THEN (CASE WHEN (xor(a, ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS INT), 1))::UBIGINT) & 1) = 1 THEN xor(xor(a, ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS INT), 1))::UBIGINT) >> 1, 3988292384::UBIGINT) ELSE xor(a, ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS INT), 1))::UBIGINT) >> 1 END)
              ELSE (CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) END) AS crc)) AS crc FROM (SELECT c, count(*) AS own FROM o GROUP BY c)),
     n AS (SELECT c, own, CAST(xor(crc, 4294967295::UBIGINT) % 9 AS BIGINT) AS h, c - c % 5 AS base FROM h),
     k AS (SELECT n.c, n.h, n.base, least(n.h, coalesce(b.own, 0)) AS k FROM n LEFT JOIN n b ON b.c = n.base),
     r AS (SELECT k.c, o.pos, role, text FROM k JOIN o ON o.c = k.base AND o.pos < k.h UNION ALL SELECT k.c, k.k + o.pos - k.h, role, text FROM k JOIN o ON o.c = k.c AND o.pos >= k.h),
     p AS (SELECT c, pos + 1 AS d, sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY pos)) AS key, strlen(text) AS bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM k),
     l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
     nodes AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY d, key),
     up AS (SELECT DISTINCT a.d, a.key, b.d AS bd, b.key AS bkey FROM p a JOIN p b ON a.c = b.c AND a.d = b.d - 1),
     kids AS (SELECT d, key, count(*) AS n_children FROM up GROUP BY d, key),
     whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, key)),
     sub AS (SELECT DISTINCT a.d, a.key, b.d AS bd, b.key AS bkey FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
     sums AS (SELECT sub.d, sub.key, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.bytes) AS BIGINT) AS saved_tokens FROM sub JOIN whole w ON w.d = sub.bd AND w.key = sub.bkey GROUP BY sub.d, sub.key),
     ends AS (SELECT p.d, p.key, sha256(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c)) AS sha FROM p JOIN l ON l.c = p.c AND l.len = p.d GROUP BY p.d, p.key)
SELECT w.conv_id, w.d AS depth, parent.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM whole w JOIN sums USING (d, key) LEFT JOIN ends USING (d, key) LEFT JOIN up ON up.bd = w.d AND up.bkey = w.key LEFT JOIN nodes parent ON parent.d = up.d AND parent.key = up.key
"""
