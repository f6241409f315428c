"""Operators on small odd inputs: adaptive counts, linear prediction, Hilbert order, resampling, draws, nested keys, aggregates."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.hilbert import hilbert_place
from brindle.functions.likelihood import log_gamma, logistic_mixture_nll
from brindle.functions.lpc import autocorrelation, integer_weights, levinson, residuals
from brindle.operators import numbering
from brindle.operators.adaptive import code_length, context_counts, symbols
from brindle.operators.draws import cumulative, weighted_draws
from brindle.operators.mergeable import aggregated
from brindle.operators.nested import found_keys, walked
from brindle.operators.resample import resampled, taps


def plain_bits(body):
    counts, total = Counter(), 0.0
    for n, b in enumerate(body):
        bits, done = 0.0, False
        for order in (2, 1, 0):
            if n >= order and not done:
                context = bytes(body[n - order : n])
                hits, uses = counts[order, context, b], counts[order, context]
                bits -= math.log2((hits or 1) / (uses + 1))
                done = hits > 0
        total += bits + (0 if done else 8)
        for order in (2, 1, 0):
            if n >= order:
                context = bytes(body[n - order : n])
                counts[order, context, b] += 1
                counts[order, context] += 1
    return total


@pytest.mark.parametrize("block, span", [(1 << 20, 1 << 16), (5, 7)])
def test_adaptive_code_length_against_a_loop(spark, monkeypatch, block, span):
    monkeypatch.setattr(numbering, "BLOCK", block)
    monkeypatch.setattr(numbering, "SPAN", span)
    bodies = {1: b"a", 2: b"aaaaaaaaaaaaaaaaaaaaaaa", 3: "abracadabra, abracadabra éé".encode(), 4: bytes(range(60)) * 2}
    rows = [(i, k, body[16 * k : 16 * k + 16]) for i, body in bodies.items() for k in range(-(-len(body) // 16))]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk long, body binary").repartition(3)
    sums = context_counts(symbols(chunks, size=16)).groupBy("doc_id").agg(F.sum(code_length()).alias("bits"), F.count(F.lit(1)).alias("n"))
    got = {r.doc_id: (r.n, r.bits) for r in sums.collect()}
    assert got == {i: (len(body), pytest.approx(plain_bits(body))) for i, body in bodies.items()}
    assert context_counts(symbols(chunks.where("false"))).count() == 0


def test_levinson_against_normal_equations(spark):
    rng = np.random.default_rng(0)
    frames = [rng.integers(-500, 500, 40).cumsum().tolist(), [0] * 10, [5], [3, -3], [7] * 12]
    rows = spark.createDataFrame(list(enumerate(frames)), "i int, xs array<long>").select("i", "xs", autocorrelation(F.col("xs"), 4).alias("r")).withColumn("o", levinson(F.col("r"), 4))
    for row in rows.collect():
        xs = np.array(row.xs, float)
        r = [float(xs[j:] @ xs[: len(xs) - j]) if j < len(xs) else 0.0 for j in range(5)]
        assert row.r == r and [len(o.a) for o in row.o] == [1, 2, 3, 4]
        if row.i in (0, 4):
            for m, o in enumerate(row.o, 1):
                system = np.array([[r[abs(a - b)] for b in range(m)] for a in range(m)])
                assert o.a == pytest.approx(np.linalg.solve(system, r[1 : m + 1]).tolist(), rel=1e-6, abs=1e-9)
    assert all(o.a == [0.0] * len(o.a) for row in rows.where("i = 1").collect() for o in row.o)
    coded = rows.where("i = 0").select("xs", integer_weights(F.col("o")[2]["a"]).alias("w")).withColumn("z", residuals(F.col("xs"), F.col("w"))).first()
    back = coded.xs[:3]
    for z in coded.z:
        e = z // 2 if z % 2 == 0 else -(z + 1) // 2
        back.append(e + (sum(w * back[-j] for j, w in enumerate(coded.w, 1)) >> 10))
    assert back == coded.xs


def test_neighbours_on_the_hilbert_curve(spark):
    rows = spark.range(256).selectExpr("id % 16 AS x", "id div 16 AS y").withColumn("d", hilbert_place(F.col("x"), F.col("y"), 4)).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_resampling_keeps_slow_waves(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SPAN", 32)
    wave = spark.range(200).selectExpr("1 AS track_id", "id AS n", "cos(id * 0.2) AS x")
    for up, down in ((3, 2), (1, 2), (1, 1)):
        got = {r.m: r.y for r in resampled(wave, up, down).collect()}
        assert sorted(got) == list(range(math.ceil(200 * up / down)))
        inner = [m for m in got if 30 < m * down / up < 170]
        assert all(got[m] == pytest.approx(math.cos(m * down / up * 0.2), abs=0.02) for m in inner)
    assert [len(row) for _, row in taps(3, 2)] == [13, 13, 13]


def test_draws_follow_weights(spark):
    weights = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(1, 400)] + [(1000, 50_000), (2000, None)], "item long, weight long")
    edges = sorted((r.low, r.high, r.item) for r in cumulative(weights).collect())
    assert edges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(edges, edges[1:])) and [e[2] for e in edges] == sorted(e[2] for e in edges)
    total = edges[-1][1]
    drawn = weighted_draws(spark.range(total).withColumnRenamed("id", "slot"), weights, lambda total: F.col("slot"))
    assert Counter(r.item for r in drawn.collect()) == {item: high - low for low, high, item in edges}
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert weighted_draws(spark.range(3).withColumnRenamed("id", "slot"), weights.where("false"), lambda total: F.lit(0)).count() == 0


def test_keys_at_any_depth(spark):
    deep = '{"k": 1}'
    for _ in range(40):
        deep = f'{{"a": [{deep}]}}'
    texts = [None, "", "{bad", "7", '"k"', "[]", "{}", '{"value": {"value": {"k": {"value": [1, {"k": null}]}}}}', deep, '{"value": 1, "k": 2}', '{"k": {"k": {"k": {"k": {"k": {"k": 6}}}}}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, config string")
    found = Counter((r.id, r.depth, r.path) for r in found_keys(rows, "id", "config", "k").select("id", "depth", "path").collect())
    assert found == Counter([(7, 1, "$.k"), (7, 3, "$.k[1].k"), (8, 81, "$" + ".a[0]" * 40 + ".k"), (9, 1, "$.k"), *((10, d, "$" + ".k" * d) for d in range(1, 7))])
    assert walked(rows, "id", "config").where("depth = 0").count() == len(texts)


def test_aggregates_with_partial_buffers(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 7, None if i % 5 == 0 else float(i)) for i in range(1000)], "k int, v double").repartition(9)

    def add(buffer, values):
        buffer += len(values), values.sum()

    got = {r.k: tuple(r.buffer) for r in aggregated(rows, "k", "v", 2, add).collect()}
    kept = [(None if i % 7 == 0 else i % 7, float(i)) for i in range(1000) if i % 5]
    assert got == {k: (sum(a == k for a, _ in kept), sum(v for a, v in kept if a == k)) for k in {a for a, _ in kept}}


def test_likelihoods(spark):
    shown = spark.range(1, 60).select((F.col("id") / 4).alias("z")).withColumn("g", log_gamma(F.col("z"))).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.z), rel=1e-11, abs=1e-11) for r in shown)
    level, lit = F.col("id"), F.lit
    nll = logistic_mixture_nll(level, 256, [lit(0.3), lit(-0.2)], [lit(-1.2), lit(0.4)], [lit(0.01), lit(0.3)])
    assert spark.range(256).select(F.sum(F.exp(-nll)).alias("p")).first().p == pytest.approx(1.0, abs=1e-9)


def test_subframes_by_the_shape_of_their_samples(spark):
    from brindle.plans.lpc_queries import subframe_sizes

    def bits(z):  # the definition: the parameter from the mean, a unary quotient with its end mark, and the rest
        from brindle.functions.entropy import PHI

        mean = sum(z) / len(z)
        k = 0 if mean < PHI else 1 + int(math.log2(math.log(PHI - 1) / math.log(mean / (mean + 1))))
        return sum((v >> k) + 1 + k for v in z)

    flat, ramp = [7] * 32, [5 * n + 3 for n in range(32)]
    noise = np.random.default_rng(5).integers(-(1 << 31), 1 << 31, 32).tolist()  # its lag sums pass 64 bits unless shifted
    rows = [(0, 0, flat), (0, 1, ramp), (0, 2, noise), (0, 3, [9]), (0, 4, [1, -4])]
    found = subframe_sizes(spark.createDataFrame(rows, "track_id long, frame long, xs array<bigint>")).collect()
    least = {f: min((r.bits, r.kind, r.m) for r in found if r.frame == f) for f in range(5)}
    assert least[0] == (40, "constant", 0)
    assert least[1] == (16 + 2 * 32 + 30, "fixed", 2)  # residuals of a ramp are zero: a bit each
    assert least[2] == (8 + 32 * 32, "verbatim", 0)
    assert least[3][1] in ("constant", "fixed") and not any(r.m > 0 for r in found if r.frame == 3)
    assert {(r.kind, r.m) for r in found if r.frame == 4} >= {("fixed", 0), ("fixed", 1), ("lpc", 1), ("verbatim", 0)}
    first = {r.m: r.bits for r in found if r.frame == 2 and r.kind == "fixed"}
    steps = [b - a for a, b in zip(noise, noise[1:])]
    assert first[1] == 16 + 32 + bits([2 * e if e >= 0 else -2 * e - 1 for e in steps])
