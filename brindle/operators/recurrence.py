"""Linear recurrences x[n] = e[n] + a1 x[n-1] + ... + ap x[n-p] over tracks of any length, as an associative scan.

What a block does to the p samples before it is an affine map: a power of the companion matrix, which depends on the
block's length alone, and an offset, which is the end state of the block run from zeros. Blocks of `BLOCK` samples are
folded to their offsets, these in groups of `GROUP` to the offsets of groups, and those track by track: each level hands
the states at which its parts begin to the level below, and every block is then solved apart. So a track is many tasks'
work, and no task folds more than max(BLOCK, GROUP, groups of a track) values one after the other.

Folds are `aggregate` expressions over arrays. Integer weights are computed in integers, group states in decimals of 38
digits, since powers of the matrix may grow where the samples don't; other weights in doubles.

Defined results: samples before a track are zeros; numbers n go from 0 on without gaps; a null residual makes all that
follow it on its track null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
GROUP = 1024


def _matrix_power(weights: list, n: int) -> list[list]:
    """The companion matrix of the weights to the n-th power, in Python numbers."""
    p = len(weights)
    one = [[type(weights[0])(i == j) for j in range(p)] for i in range(p)]
    base = [list(weights), *([type(weights[0])(j == i) for j in range(p)] for i in range(p - 1))]
    times = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(p)) for j in range(p)] for i in range(p)]
    while n:
        if n & 1:
            one = times(one, base)
        base, n = times(base, base), n >> 1
    return one


def _zeros(p: int, kind: str) -> Column:
    return F.array(*(F.lit(0).cast(kind) for _ in range(p)))


def _step(state: Column, e: Column, weights: list, kind: str) -> Column:
    """The state (latest sample first) after one more residual."""
    x = e.cast(kind)
    for j, w in enumerate(weights):
        x = x + F.lit(w).cast(kind) * state[j]
    return F.concat(F.array(x.cast(kind)), F.slice(state, 1, len(weights) - 1)) if len(weights) > 1 else F.array(x.cast(kind))


def _mapped(state: Column, offset: Column, matrix: list[list], kind: str) -> Column:
    """matrix x state + offset."""
    rows = []
    for i, row in enumerate(matrix):
        x = offset[i]
        for j, m in enumerate(row):
            x = x + (F.lit(str(m)) if kind.startswith("decimal") else F.lit(m)).cast(kind) * state[j]
        rows.append(x.cast(kind))
    return F.array(*rows)


def _starts(offsets: Column, first: Column, matrix: list[list], kind: str) -> Column:
    """The states at which parts with these offsets begin, the first of them at `first`."""
    onto = lambda states, b: F.concat(states, F.array(_mapped(F.element_at(states, -1), b, matrix, kind)))
    return F.slice(F.aggregate(offsets, F.array(first), onto), F.lit(1), F.size(offsets))


def solved(residuals: DataFrame, weights: list, key: str = "track_id", n: str = "n", e: str = "e") -> DataFrame:
    """key, n, x: the samples whose residuals these are."""
    whole = all(isinstance(w, int) for w in weights)
    weights, p = (weights if whole else [float(w) for w in weights]), len(weights)
    fine, wide = ("bigint", "decimal(38,0)") if whole else ("double", "double")
    ordered = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    blocks = residuals.groupBy(key, F.expr(f"{n} div {BLOCK}").alias("block")).agg(F.transform(ordered(n, e), lambda s: s[e]).alias("es"))
    # a block's offset may pass 64 bits before its samples do
    ended = F.aggregate("es", _zeros(p, wide), lambda state, x: _step(state, x, weights, wide))
    offsets = blocks.select(key, "block", ended.alias("offset"))
    groups = offsets.groupBy(key, F.expr(f"block div {GROUP}").alias("group")).agg(F.transform(ordered("block", "offset"), lambda s: s["offset"]).alias("offsets"))
    by_block, by_group = _matrix_power(weights, BLOCK), _matrix_power(weights, BLOCK * GROUP)
    grown = F.aggregate("offsets", _zeros(p, wide), lambda state, b: _mapped(state, b, by_block, wide))
    tracks = groups.select(key, "group", grown.alias("offset")).groupBy(key).agg(F.transform(ordered("group", "offset"), lambda s: s["offset"]).alias("offsets"))
    first = tracks.select(key, F.posexplode(_starts(F.col("offsets"), _zeros(p, wide), by_group, wide)).alias("group", "first"))
    begun = groups.join(first, [key, "group"]).select(key, "group", F.posexplode(_starts(F.col("offsets"), F.col("first"), by_block, wide)).alias("at", "start"))
    start = begun.select(key, (F.col("group") * GROUP + F.col("at")).alias("block"), F.col("start").cast(f"array<{fine}>").alias("start"))
    onto = lambda made, x: F.struct(_step(made["state"], x, weights, fine).alias("state"), F.concat(made["xs"], F.array(_step(made["state"], x, weights, fine)[0])).alias("xs"))
    made = F.aggregate("es", F.struct(F.col("start").alias("state"), F.array().cast(f"array<{fine}>").alias("xs")), onto, lambda made: made["xs"])
    samples = blocks.join(start, [key, "block"]).select(key, "block", F.posexplode(made).alias("at", "x"))
    return samples.select(key, (F.col("block") * BLOCK + F.col("at")).alias(n), "x")
