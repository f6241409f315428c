"""Code lengths of adaptive context models: every symbol is paid for with what came before it, and nothing else.

The counts so far of a symbol in its context are its number among the equal ones of its track (`numbered`, in two levels,
so a symbol that fills a track is many tasks' work), and the uses so far of a context are the count so far of the symbol
before it in a context one shorter, which is one row back. So three numberings and one step back give all counts of
orders 0 to 2, without a state that goes through a track symbol by symbol.

A text is one row, so its bytes are with one task before anything is counted. `text_code_lengths` counts them there in the
same way, by sorts of stretches instead of shuffles of bytes, and only sums leave the task. `context_counts` is for
tracks whose symbols are rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .numbering import numbered, with_neighbours


def symbols(chunks: DataFrame, key: str = "doc_id", size: int = 2048) -> DataFrame:
    """key, n, b: each byte and its place in its track; chunks: key, chunk, body (of `size` bytes, the last may be shorter)."""
    ship(chunks.sparkSession)

    def of(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                bodies = [np.frombuffer(x, np.uint8) for x in part.column(2).to_pylist()]
                sizes = np.array([len(x) for x in bodies])
                first = np.repeat(part.column(1).to_numpy() * size - (np.cumsum(sizes) - sizes), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(part)), sizes))), pa.array(first + np.arange(sizes.sum())), pa.array(np.concatenate(bodies).astype(np.int32))], names=[key, "n", "b"])

    return chunks.select(key, "chunk", "body").mapInArrow(of, f"{key} {dict(chunks.dtypes)[key]}, n long, b int")


def context_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, n, b) with c0, c1, c2 (times that b stood here before, after none, one and two symbols) and u1, u2 (times
    that those contexts were there before; that of order 0 was n times)."""
    near = with_neighbours(rows, lambda w: {"b1": F.lag("b", 1).over(w), "b2": F.lag("b", 2).over(w)}, 2, key=key)
    for order, names in enumerate((("b",), ("b1", "b"), ("b2", "b1", "b"))):
        near = numbered(near.withColumn("_key", F.struct(key, *names)), "_key", ["n"], f"c{order}").drop("_key")
    before = lambda c: lambda w: F.lag(c, 1).over(w)
    return with_neighbours(near, lambda w: {"u1": before("c0")(w), "u2": before("c1")(w)}, 1, key=key)


#: Bytes that are sorted at once. Symbols of order 1 and places in a stretch take 32 bits together; longer texts go in pieces.
STRETCH = 1 << 16
#: Logarithms of whole numbers, which most counts are among; at 0, which is looked up but not used, stands 0.
_LOG2 = np.log2(np.maximum(np.arange((1 << 16) + 2), 1))


def _log2(x: np.ndarray) -> np.ndarray:
    return _LOG2[x] if x.max(initial=0) < len(_LOG2) else np.log2(np.maximum(x, 1))


def _earlier(symbols: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """How many equal symbols of the same run stand before each; runs: numbers that don't fall, one a symbol."""
    bits = max(len(symbols) - 1, 1).bit_length()
    ordered = np.sort(symbols << symbols.dtype.type(bits) | np.arange(len(symbols), dtype=symbols.dtype))
    places, here = ordered & symbols.dtype.type((1 << bits) - 1), np.arange(len(symbols))
    kinds, runs = ordered >> symbols.dtype.type(bits), runs[places]
    first = np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (runs[1:] != runs[:-1])])
    counts = np.empty(len(symbols), np.int64)
    counts[places] = here - np.maximum.accumulate(np.where(first, here, 0))
    return counts


class _Stretch:
    """Sums of code lengths over stretches of bytes: of several texts each, or of pieces of one text in order, whose counts go on."""

    def __init__(self, goes_on: bool = False):
        self.n, self.tail, self.uses = 0, np.zeros(2, np.uint8), (0, 0)
        # counts of every symbol in every context so far; pages that no context touches take no memory
        self.seen = [np.zeros(1 << 8 * order, np.int32) for order in (1, 2, 3)] if goes_on else None

    def sums(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """text (its number), octave, bytes, bits, bits of order 0, escapes: a row for each doubling of a text's length.

        data: uint8; starts: where each text begins in it."""
        n = np.arange(len(data)) + self.n
        n -= np.repeat(starts, np.diff(starts, append=len(data)))
        behind = np.concatenate([self.tail, data])
        b, b1, b2 = data.astype(np.uint32), behind[1:-1].astype(np.uint32), behind[:-2].astype(np.uint64)
        symbols = [b, b1 << np.uint32(8) | b]
        symbols.append(b2 << np.uint64(16) | symbols[1])
        # the first bytes of a text have no context: in the orders above theirs they are runs of their own
        counts = [_earlier(s, np.cumsum(n <= order)) for order, s in enumerate(symbols)]
        if self.seen:
            for order, (seen, s) in enumerate(zip(self.seen, symbols)):
                counts[order] += np.where(n >= order, seen[s], 0)
                seen[s[n >= order]] = counts[order][n >= order] + 1  # of equal symbols the last counts
        c0, c1, c2 = counts
        # a context was used as often as its last symbol was seen in the context one shorter, a row back
        u1, u2 = np.concatenate([[self.uses[0]], c0[:-1]]), np.concatenate([[self.uses[1]], c1[:-1]])
        u1[n < 1], u2[n < 2] = 0, 0
        length = _log2(n + 1)
        order0 = np.where(c0 > 0, length - _log2(c0), length + 8)
        order1 = _log2(u1 + 1) + np.where(c1 > 0, -_log2(c1), order0)
        bits = _log2(u2 + 1) + np.where(c2 > 0, -_log2(c2), order1)
        self.n, self.tail, self.uses = n[-1] + 1, behind[-2:], (c0[-1], c1[-1])
        ends = n & n + 1 == 0  # n + 1 is a power of two
        ends[0] = True
        at = np.flatnonzero(ends)
        return [np.searchsorted(starts, at, "right") - 1, np.frexp(n[at] + 1)[1] - 1, np.diff(at, append=len(data)), *(np.add.reduceat(x, at) for x in (bits, order0, (c2 == 0).astype(np.int64)))]


def text_code_lengths(texts: DataFrame, key: str, text: str, size: int | None = None) -> DataFrame:
    """key, octave, bytes, bits, bits_order0, escapes: what the UTF-8 bytes n of a text take, summed by floor(log2(n + 1)).

    Code lengths are those of `code_length`, escapes are bytes that order 2 hasn't seen in their context. Texts without
    bytes have no row; a long text has several rows of an octave, a row a piece.
    """
    ship(texts.sparkSession)
    size = size or STRETCH

    def stretches(ends: np.ndarray, data: np.ndarray):
        at, last = 0, len(ends) - 1
        while at < last:
            to = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
            if to > at:
                yield at, _Stretch().sums(data[ends[at] : ends[to]], ends[at:to] - ends[at])
            else:
                to, stretch = at + 1, _Stretch(goes_on=True)
                for begin in range(ends[at], ends[to], size):
                    yield at, stretch.sums(data[begin : min(begin + size, ends[to])], np.zeros(1, np.int64))
            at = to

    def of(batches):
        for batch in batches:
            if len(batch):
                body = batch.column(1).cast(pa.large_binary())
                ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
                found = [[rows[0] + at, *rows[1:]] for at, rows in stretches(ends, np.frombuffer(body.buffers()[2], np.uint8))]
                of_text, *sums = (np.concatenate(x) for x in zip(*found))
                octave, count, bits, order0, escapes = sums
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_text)), *map(pa.array, (octave.astype(np.int64), count, bits, order0, escapes))], names=[key, "octave", "bytes", "bits", "bits_order0", "escapes"])

    rows = texts.where(F.octet_length(text) > 0).select(key, text)
    return rows.mapInArrow(of, f"{key} {dict(texts.dtypes)[key]}, octave long, bytes long, bits double, bits_order0 double, escapes long")


def code_length() -> Column:
    """Bits of a row of context_counts: order 2 if the symbol was seen there, or else an escape to order 1, to 0, to one of 256."""
    bits = lambda hits, uses: -F.log2(hits / (uses + 1))
    order0 = F.when(F.col("c0") > 0, bits(F.col("c0"), F.col("n"))).otherwise(bits(F.lit(1), F.col("n")) + 8)
    order1 = F.when(F.col("n") < 1, order0).when(F.col("c1") > 0, bits(F.col("c1"), F.col("u1"))).otherwise(bits(F.lit(1), F.col("u1")) + order0)
    return F.when(F.col("n") < 2, order1).when(F.col("c2") > 0, bits(F.col("c2"), F.col("u2"))).otherwise(bits(F.lit(1), F.col("u2")) + order1)
