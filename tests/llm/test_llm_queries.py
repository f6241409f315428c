"""The opN queries themselves on the smallest tables: their columns, their SQL, and plain versions of what has no SQL."""

import os
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from brindle.llm import embedding_passes, labelled, quality_lsa, toxicity_fm
from brindle.llm.common import hot_join, staged
from brindle.llm.labelled import fit_sample, fold
from brindle.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_host_suffix": "page_id bigint, url string, text string, n_chars bigint",
    "op2_warc_bundles": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_quality_knn": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_embedding_passes": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_token_frames": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_sentencepiece": "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_chars bigint, decoded_crc32 bigint",
    "op10_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op13_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name: QUERIES[name](spark, SF) for name in COLUMNS}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(name, results, docs, spark):
    got = results[name]
    assert dict(got.dtypes) == dict(x.split() for x in COLUMNS[name].split(", "))
    if name in ("op11_hard_negatives", "op13_prefix_trie"):
        return  # a row for each triple, and each node: test_sql counts them
    table = {"1": "pages", "2": "pages", "6": "embeddings"}.get(re.match(r"op(\d+)_", name)[1], "documents")
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, results, duck):
    want = duck(SF).execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    assert plain(results[name].select(*columns).collect()) == plain(want.fetchall())


def test_scores_and_folds(results):
    for name, folds, out in (("op3_toxicity", 3, 1), ("op5_quality_knn", 4, 2)):
        for r in results[name].collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out)
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_sizes_and_targets(results, docs):
    sizes = Counter()
    for r in docs.values():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    rows = results["op4_source_mix"].collect()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and r.source_size == sizes[docs[r.doc_id].source] and r.taken <= 3 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[docs[r.doc_id].source] += r.taken
    assert all(abs(taken[docs[r.doc_id].source] - r.target) <= 128 + 0.03 * r.target for r in rows)


def test_tokens_are_numbered_on(results):
    rows = sorted(results["op7_token_frames"].collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]


def test_pieces_match_the_library(results, docs):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in results["op9_sentencepiece"].collect():
        ids = lib.encode(docs[r.doc_id].text or "")
        text = lib.decode(ids)
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.decoded_chars, r.decoded_crc32) == (len(text), zlib.crc32(text.encode()))


def test_fingerprints_are_hex(results):
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in results["op10_simhash_dedup"].collect())


def test_machine_scores_against_a_double_loop(spark):
    rng = np.random.default_rng(0)
    machine = toxicity_fm.FactorizationMachine(np.arange(20), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    rows = [sorted(rng.choice(20, k, replace=False).tolist()) for k in (0, 1, 2, 7, 20)]
    for row, got in zip(rows, machine.score(rows)):
        z = 0.3 + sum(machine.w[i] for i in row)
        for a, i in enumerate(row):
            for j in row[a + 1 :]:
                z += float(machine.v[i] @ machine.v[j])
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_chosen_buckets_against_a_plain_chi_square(spark):
    rng = np.random.default_rng(2)
    words = [f"word{chr(97 + i)}x" for i in range(20)]
    rows = [(" ".join(rng.choice(words[:10] if y else words[5:], 6)), int(y)) for y in rng.integers(0, 2, 200)]
    sample = spark.createDataFrame(rows, "text string, y int")
    chosen = toxicity_fm.fit(sample, features=8, epochs=1).chosen.tolist()
    index, n, positive = toxicity_fm.TermIndex(), len(rows), sum(y for _, y in rows)
    df, hits = Counter(), Counter()
    for text, y in rows:
        for b in index.terms(text):
            df[b] += 1
            hits[b] += y
    share = positive / n
    chi = {b: (hits[b] - c * share) ** 2 / (c * share * (1 - share) * (1 - c / (n + 1)) + 1e-9) for b, c in df.items() if c >= 3}
    assert chosen == sorted(sorted(chi, key=lambda b: (-chi[b], b))[:8])


def test_sample_is_bounded_in_rows(spark):
    docs = spark.range(500).selectExpr("id % 4 AS doc_id", "concat('t', id) AS text", "id AS y")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None), (9, 1), (3, 1)], "doc_id long, quality int")
    rows = fit_sample(docs, labels, "quality", fold("doc_id", 3) >= 0, 3).collect()
    assert sorted((r.text, r.y) for r in rows) == [("t0", 1), ("t1", 0), ("t103", 1)]


def test_a_toxicity_task_remembers_words_and_not_their_terms():
    """The terms of new words, five a word, once took most of what a worker held through the stages after it."""
    import tracemalloc

    text = " ".join(f"{i:06d}{'word' * 2}{i}" for i in range(20_000))
    index = toxicity_fm.TermIndex(np.arange(1024))
    tracemalloc.start()
    try:
        found = index.terms(text)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 20_000 * 300 and len(index.blank) + len(index.known) == 20_000
    assert found == sorted({b for w in text.split() for n in toxicity_fm.STEMS if (b := toxicity_fm.bucket(w if len(w) <= n else w[:n] + "*")) < 1024})


def test_quality_ties_vote_together():
    model = quality_lsa.QualityModel(np.ones(2), np.eye(2), np.array([[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 5), np.array([1.0] * 20 + [0.0] * 20 + [1.0] * 5))
    assert model.score(np.array([[1.0, 0.0], [0.0, 1.0]])).tolist() == pytest.approx([0.5, 1.0], abs=1e-9)


def test_hot_join(spark):
    rows = staged(spark.range(20_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS x"), "rows")
    groups = staged(rows.groupBy("k").count().withColumnRenamed("count", "n").where("k % 5 <> 1"), "groups")
    got = hot_join(rows, groups, "k", "n", 20_000)
    want = rows.join(groups, "k")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_vectors_by_double_components_and_reused_ids(spark):
    tiny = [1.0, 1e-9, 0.0]
    rows = [(1, tiny), (2, [1.0, 0.0, 0.0]), (3, [1e300, 0.0, 0.0]), (4, [0.0, 0.0, 1e-300]), (4, [1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 1e-5])]
    got = sorted(((r.id, r.n_links, r.component_id) for r in embedding_passes.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (4, 3, 1), (None, 1, None), (None, 1, None)], key=str)


def test_operators_ship_themselves(tmp_path):
    """From a folder that workers can't import the package from, on a table of the user's own."""
    root = Path(labelled.__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from brindle.llm.host_suffix import main_texts
from brindle.llm.simhash_golay import fingerprints
pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
assert main_texts(pages).first().text == "x"
assert fingerprints(pages.selectExpr("page_id AS doc_id", "html AS text")).count() == 1
print("shipped")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped" in done.stdout, done.stderr[-2000:]


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as pipeline

    from brindle.llm import source_mix
    from tests.llm.test_text_ops import brute_groups, brute_print, lower, plain_taken

    docs = staged(spark.read.parquet(f"{SF}/documents.parquet"), "docs")
    stages = dict(pipeline.STAGES)
    kept = staged(stages["exact dedup"](spark, docs, SF), "kept")
    largest = {}
    for r in docs.collect():
        largest[lower(r.text)] = max(largest.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(largest.values())
    distinct = staged(stages["simhash near-dedup"](spark, kept, SF), "distinct")
    groups = brute_groups({r.doc_id: brute_print(r.text) for r in kept.collect()})
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(set(groups.values()))
    some = staged(distinct.limit(40), "some")
    mixed = Counter()
    for r in stages["source mix"](spark, some, SF).collect():
        mixed[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    rows, plan, _ = source_mix.mix(some)
    laid = rows.collect()
    taken = plain_taken(laid, plan.collect())
    assert +mixed == +Counter({r.id: taken[r.place, r.start] for r in laid})
