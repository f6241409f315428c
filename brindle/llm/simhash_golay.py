"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: segments A and B of 23 and C of 18 (padded with zeros to 23). The binary Golay code
[23, 12, 7] is perfect: each 23-bit word lies within 3 bits of exactly one codeword. If two words differ in at most
one bit, the codeword nearest to the first lies within 4 bits of the second, and a word has at most six such
codewords. So one side gets the index of its nearest codeword, the other the indices of all within 4 bits, and two
such words always share one.

Pigeonhole for at most three differing bits: either one segment is equal and another differs in at most one bit
(tables 0 to 5: equal segment and codeword of the other), or each segment differs in exactly one bit, when one half
of B and one half of C are equal (tables 6 to 9: codeword of A and those halves). Keys have 30 to 35 bits. Candidates
are verified in the join itself, so that only true links leave it, and no link within three bits is lost.

Equal fingerprints are one node, so copies cost nothing; rows of a fingerprint or component that very many share get
their component where they are (`hot_join`). Defined results: a null or empty text, or one of white
space alone, has fingerprint zero, linked like any other; fewer than three words make one shingle; repeated rows
share their group; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import hot_join, load, parts_of, staged, tasks_for, unstage
from .components import components

MAX_BITS = 3
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Text that is read at a time.
PART_BYTES = 1 << 22
# The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a long) of each row."""
    ship(docs.sparkSession)

    def of(batches):
        for batch in (part for b in batches for part in parts_of(b, PART_BYTES)):
            found = np.fromiter((fingerprint(t or b"") for t in batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(of, f"id {dict(rows.dtypes)['id']}, fp long")


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """syndrome of each 23-bit error pattern is read off division by GOLAY; gives the nearest error and, for each
    syndrome, the errors of weight 4 or less (-1: none), all from the rule."""

    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ GOLAY << (bit - 11), x)
        return x

    patterns = [sum(1 << b for b in bits) for w in range(5) for bits in itertools.combinations(range(23), w)]
    nearest, near = np.zeros(2048, np.int64), np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for s, e in zip(remainder(np.array(patterns, np.int64)).tolist(), patterns):
        if e.bit_count() < 4:
            nearest[s] = e
        near[s, used[s]] = e
        used[s] += 1
    return nearest, near


def _syndrome(x: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ GOLAY << (bit - 11), x)
    return x


def nearest_codeword(x: np.ndarray) -> np.ndarray:
    """Index (its 12 leading bits) of the codeword within 3 bits of each word."""
    return (x ^ golay_tables()[0][_syndrome(x)]) >> 11


def near_codewords(x: np.ndarray) -> np.ndarray:
    """Indices of all codewords within 4 bits, a row a word; -1 where there are fewer than six."""
    errors = golay_tables()[1][_syndrome(x)]
    return np.where(errors < 0, -1, (x[:, None] ^ errors) >> 11)


def golay_keys(fp: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints: one codeword a fuzzy segment, or (wide) all of its near ones."""
    x = fp.view(np.uint64).astype(np.uint64)
    a, b, c = ((x >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    fuzzy = [near_codewords(s) if wide else nearest_codeword(s)[:, None] for s in (a, b, c)]
    tables = [(a, fuzzy[1]), (a, fuzzy[2]), (b, fuzzy[0]), (b, fuzzy[2]), (c, fuzzy[0]), (c, fuzzy[1])]
    tables += [(hb << 9 | hc, fuzzy[0]) for hb in (b & 4095, b >> 12) for hc in (c & 511, c >> 9)]
    keys = np.concatenate([np.where(f < 0, -1, t << 40 | e[:, None] << 12 | f) for t, (e, f) in enumerate(tables)], axis=1)
    rows, columns = np.nonzero(keys >= 0)
    return rows, keys[rows, columns]


def _keyed(fps: DataFrame, wide: bool) -> DataFrame:
    def of(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                fp = batch.column(0)[at : at + 2048].to_numpy(zero_copy_only=False)
                rows, keys = golay_keys(fp, wide)
                yield pa.record_batch([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(of, "key long, fp long")


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b for each two distinct fingerprints in fps that differ in max_bits (3 at most) or fewer bits."""
    ship(fps.sparkSession)
    if max_bits > MAX_BITS:
        raise ValueError("these tables find pairs within three bits")
    # without the hint the keys, dozens a fingerprint, would be taken for as small as the fingerprints, and be broadcast
    one, many = _keyed(fps, False).withColumnRenamed("fp", "a"), _keyed(fps, True).withColumnRenamed("fp", "b").hint("merge")
    return one.join(many, (one.key == many.key) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id (the smallest id reachable) of each row."""
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    total = prints.count()
    tasks = tasks_for(total)
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")).coalesce(tasks), "nodes")
    count = nodes.count()
    parts = components(fingerprint_links(nodes))
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "n", "least_id", F.coalesce("component", "fp").alias("component"))
    named = staged(named.coalesce(tasks), "named")
    least = staged(named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size")).coalesce(tasks), "least")
    groups = staged(hot_join(named.drop("least_id"), least, "component", "size", count, tasks).select("fp", "n", "component_id"), "groups")
    unstage(nodes, named, least)
    return hot_join(prints, groups, "fp", "n", total, tasks).select("id", "fp", "component_id")


def op10_simhash_dedup(spark, sf_dir):
    found = simhash_groups(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
