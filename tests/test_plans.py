"""Queries give the rows of their SQL on small tables of their own, made so that a looser way of reckoning fails."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import plain_bits

from brindle.operators import codecs
from brindle.operators.adaptive import text_code_lengths
from brindle.operators.prediction import order_bits, residual_bits
from brindle.plans.catalogue import ORACLES, QUERIES
from brindle.plans.lpc_queries import SAMPLE_BITS, WEIGHT_BITS, order_sizes


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def from_sql(duck, folder, name):
    """The rows that DuckDB gives, columns in order of their names."""
    con = duck("/nowhere")
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(ORACLES[name])
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)


def from_spark(spark, folder, name):
    got = QUERIES[name](spark, str(folder))
    return sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=str)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_splits_of_lengths_whose_share_is_whole(spark, duck, tmp_path):
    lengths = [1, 9, 10, 60, 90, 170, 180, 30]
    rows = [(1000 * user + i, datetime(2024, 1, 1) + timedelta(seconds=i), user if user < 7 else None, "view", i / 4, "{}") for user, n in enumerate(lengths) for i in range(n)]
    written(spark, tmp_path, events=(rows, EVENTS))
    got = from_spark(spark, tmp_path, "ordinal_split")
    assert got == from_sql(duck, tmp_path, "ordinal_split")
    assert sum(split == "train" and track == 4 for _, split, track in got) == 63
    assert len(got) == sum(lengths)


def test_rollup_to_the_cent(spark, tmp_path):
    # beside a rate of 2^50 a double has no place for most cents
    rates = [None, float(1 << 50), *[0.01] * 1000, -float(1 << 50), 1.755, -2.505, 1e6]
    orders = [(i, 1, "F", rate, datetime(2024, 1, 1), "1-URGENT") for i, rate in enumerate(rates)] + [(5000 + i, i % 3, "O", i / 4, datetime(2024, 1, 1), "2-HIGH") for i in range(6)]
    written(
        spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"), customer=([(0, 0), (1, 1), (2, 2)], "c_custkey long, c_nationkey int"),
        nation=([(0, "A", 0), (1, "B", 0), (2, None, 1)], "n_nationkey int, n_name string, n_regionkey int"), region=([(0, "X"), (1, "Y")], "r_regionkey int, r_name string"),
    )
    large, n = 1000 + 100_000_000 - 75, len(rates)
    want = [("X", "A", 2, 75, 0), ("X", "B", n + 2, large + 125, 0), ("Y", None, 2, 175, 0), ("X", None, n + 4, large + 200, 1), ("Y", None, 2, 175, 1), (None, None, n + 6, large + 375, 3)]
    assert sorted(map(tuple, QUERIES["subset_rollup"](spark, str(tmp_path)).select("domain", "dataset", "n", "cents", "level").collect()), key=str) == sorted(want, key=str)


TEXTS = ["a", "éa", "a" * 23, "abracadabra, abracadabra éé", "".join(map(chr, range(60))) * 2, "ab" * 40 + "ba" * 40, "", None]


@pytest.mark.parametrize("size", [1 << 16, 40, 3])
def test_code_lengths_of_texts_in_stretches_and_pieces(spark, size):
    texts = spark.createDataFrame([(10 * k + i, text) for k in range(3) for i, text in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    sums = text_code_lengths(texts, "doc_id", "text", size).groupBy("doc_id").agg(F.sum("bits"), F.sum("bytes"), F.max("octave"))
    bodies = {10 * k + i: text.encode() for k in range(3) for i, text in enumerate(TEXTS) if text}
    assert {r[0]: tuple(r[1:]) for r in sums.collect()} == {i: (pytest.approx(plain_bits(body)), len(body), len(body).bit_length() - 1) for i, body in bodies.items()}


@pytest.mark.parametrize("name, exchanges", [("adaptive_code_length", 2), ("adaptive_learning_curve", 1)])
def test_bytes_of_texts_stay_with_their_task(spark, duck, tmp_path, name, exchanges):
    written(spark, tmp_path, documents=([(i, text) for i, text in enumerate(TEXTS)], "doc_id long, text string"))
    assert from_spark(spark, tmp_path, name) == from_sql(duck, tmp_path, name)
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString() + QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") <= exchanges


def test_chunks_coded_side_by_side_are_those_coded_one_by_one(monkeypatch):
    monkeypatch.setattr(codecs, "LANES", 16)
    monkeypatch.setattr(codecs, "LONGEST", 2500)
    rng = np.random.default_rng(3)
    chunks = [b"", b"a", b"ab", b"a" * 3000, b"b" + b"a" * 2047, b"a" * 2047 + b"b", bytes(range(256)) * 8, *(rng.integers(0, m, n).astype(np.uint8).tobytes() for m in (2, 3, 256) for n in (1, 2, 300, 2048, 2600))]
    # bounds that straddle the middle for long, so that sums carry far
    chunks += [rng.choice([0, 1, 2], n, p=[0.998, 0.001, 0.001]).astype(np.uint8).tobytes() for n in range(1, 1000, 19)]
    codes = codecs.arithmetic_encode_all(chunks)
    assert codes == [codecs.arithmetic_encode(chunk) for chunk in chunks]
    assert codecs.arithmetic_decode_all(codes, [len(chunk) for chunk in chunks]) == chunks
    assert codecs.arithmetic_encode_all([]) == codecs.arithmetic_decode_all([], []) == []
    damaged = [codes[6][:-9] + bytes(9)]
    assert codecs.arithmetic_decode_all(damaged, [2048]) == [codecs.arithmetic_decode(damaged[0], 2048)] != [chunks[6]]


def test_chunks_are_not_coded_one_by_one(spark, duck, tmp_path, monkeypatch):
    def one(*_):
        raise AssertionError("a chunk of its own")

    monkeypatch.setattr(codecs, "arithmetic_encode", one)
    monkeypatch.setattr(codecs, "arithmetic_decode", one)
    chunks = [bytes([65 + i % 7] * (i + 1)) for i in range(70)]
    assert codecs.arithmetic_decode_all(codecs.arithmetic_encode_all(chunks), [len(chunk) for chunk in chunks]) == chunks
    texts = [*TEXTS, *("ab" * n + "c" for n in range(900, 1100, 9))]
    written(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert from_spark(spark, tmp_path, "arith_coder_roundtrip") == from_sql(duck, tmp_path, "arith_coder_roundtrip")


def test_sizes_of_blocks_of_frames_are_those_of_expressions(spark):
    rng = np.random.default_rng(4)
    frames = [rng.integers(-500, 500, n).cumsum().tolist() for n in (1, 5, 6, 7, 20, 21, 22, 100, 128)] + [[7] * 128, [0] * 30, [5 * n + 3 for n in range(128)]]
    frames += [rng.integers(-(1 << 31), 1 << 31, 128).tolist(), rng.integers(0, 3, 64).tolist(), [-(1 << 40), 1 << 40] * 40]
    rows = spark.createDataFrame([(i % 7, i, xs) for i, xs in enumerate(frames)], "track_id long, frame long, xs array<bigint>").coalesce(1)
    want = {(r.frame, r.m): r.bits for r in order_sizes(rows, range(5, 21)).collect()}
    found = order_bits(rows, range(5, 21), SAMPLE_BITS + WEIGHT_BITS, key="frame").collect()
    assert {(r.frame, m): bits for r in found for m, bits in enumerate(r.bits, 5) if bits is not None} == want
    assert [(r.frame, r.size, r.least) for r in found] == [(i, len(xs), min((bits for (f, _), bits in want.items() if f == i), default=None)) for i, xs in enumerate(frames)]


def test_predictions_whose_terms_or_sums_pass_64_bits():
    xs, weights = np.array([[1 << 40, (1 << 40) + 1, 5, 9]]), np.array([[1 << 30, -(1 << 30)]])
    z = 2 * ((1 << 20) - 5) - 1
    with pytest.raises(OverflowError):
        residual_bits(xs, np.ones((1, 4), bool), np.array([4]), weights)
    first = residual_bits(xs[:, :3], np.ones((1, 3), bool), np.array([3]), weights)
    k = 1 + int(np.log2(np.log((np.sqrt(5) - 1) / 2) / np.log(z / (z + 1))))
    assert first.tolist() == [(z >> k) + 1 + k]


ITEMS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"


def test_sizes_by_order_with_prices_that_are_null(spark, duck, tmp_path):
    rng = np.random.default_rng(5)
    lengths = {1: 300, 2: 5, 3: 6, 4: 140, 5: 40, None: 30}
    gone = {1: range(40, 60), 4: range(128, 140), 5: range(40)}  # some samples of a frame, all of a last frame, all of a track
    items = [(i, 1, track, 1, 1.0, None if i in gone.get(track, ()) else float(rng.integers(900, 90_000)), 0.0, datetime(2024, 1, 1)) for track, n in lengths.items() for i in range(n)]
    written(spark, tmp_path, lineitem=(items, ITEMS))
    assert from_spark(spark, tmp_path, "lpc_sizes_by_order") == from_sql(duck, tmp_path, "lpc_sizes_by_order")
