"""Toxicity, quality, tokens, SentencePiece, exact and near dedup, mixing: against brute force and libraries."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from brindle.llm import exact_dedup, quality_lsa, sentencepiece_fst, simhash_golay, source_mix, token_frames, toxicity_fm
from brindle.llm.common import fresh_path, staged
from brindle.llm.components import components
from brindle.llm.labelled import fold

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "  ", "one", "one two", "One two three four five", "one two three four five", "ÄÖ straße▁x  y", "a\tb\nc\x0bd", "word " * 3000, " nbsp x", "😀 emoji 😀", " lead", "trail ", "one two three four five six", "𝔘nicode ퟿"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", 0, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s2", 0, "x", "y", "z"), (None, "one", None, None, None, None, None, None)]
    return staged(spark.createDataFrame(rows, SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_exact_dedup(odd, empty):
    got = exact_dedup.exact_dedup(odd.select("doc_id", "text", "kept")).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[lower(r.text)].append(r.doc_id)
    assert len(got) == odd.count()
    for r in got:
        ids = groups[lower(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256(lower(r.text).encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def dedup_rows(found):
    return sorted((r.doc_id, r.keep_id, r.group_size) for r in found.collect())


def test_exact_dedup_chains_colliding_keys_and_splits(spark):
    wide = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 1500) AS text")
    want = sorted((i, max(range(i % 1500, 4000, 1500)), len(range(i % 1500, 4000, 1500))) for i in range(4000))
    for how in ({}, {"capacity": 10}, {"key_bits": 6, "capacity": 10}, {"key_bits": 6, "hot_share": 1.0}, {"capacity": 10, "max_depth": 3}):
        assert dedup_rows(exact_dedup.exact_dedup(wide, **how)) == want
    entries = exact_dedup.build_index(wide, capacity=10).select("bucket", "local_depth", "key", "chain_pos").distinct()
    assert entries.count() == 1500 and entries.agg({"chain_pos": "max"}).first()[0] == 1
    assert entries.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 10
    chained = exact_dedup.build_index(wide, key_bits=6, capacity=10)
    assert chained.agg({"chain_pos": "max"}).first()[0] > 10 and chained.select("key", "chain_pos").distinct().count() == 1500


def test_exact_dedup_results_come_from_the_owners_chains(spark, monkeypatch):
    wide = spark.range(600).selectExpr("id AS doc_id", "concat('text ', id % 100) AS text")
    want = dedup_rows(exact_dedup.exact_dedup(wide))
    with monkeypatch.context() as broken:  # chains that don't compare bytes take colliding keys for one text
        broken.setattr(exact_dedup, "TEXT", exact_dedup.CHAIN)
        assert dedup_rows(exact_dedup.exact_dedup(wide, key_bits=3, hot_share=1.0)) != want
    with monkeypatch.context() as broken:  # a directory that has lost a leaf loses its rows
        whole = exact_dedup.directory_of
        broken.setattr(exact_dedup, "directory_of", lambda *a: whole(*a).where("leaf <> 0"))
        assert len(dedup_rows(exact_dedup.exact_dedup(wide, key_bits=3, hot_share=1.0))) < 600
    assert dedup_rows(exact_dedup.exact_dedup(wide, key_bits=3, hot_share=1.0)) == want


def test_exact_dedup_hot_text_and_clashing_columns(spark):
    rows = spark.range(9000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'THE same', concat('text ', id div 2)) AS text", "id % 7 AS key", "'x' AS body", "id AS local_depth", "'y' AS bucket", "id AS row", "'z' AS owner", "'k' AS kept")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(rows).collect()}
    assert len(got) == 9000 and all((r.key, r.body, r.local_depth, r.bucket, r.row, r.owner) == (i % 7, "x", i, "y", i, "z") for i, r in got.items())
    assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (8997, 3000, i == 8997) for i in range(0, 9000, 3))
    assert exact_dedup.exact_dedup(rows, columns=["doc_id"]).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute_print(text):
    words = WORDS.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in prints}


def test_simhash(odd, empty, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in rows.items()}
    got = {r.id: r for r in simhash_golay.simhash_groups(docs).collect()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_groups(prints)
    assert {(r.id, r.fp & (2**64 - 1)) for r in simhash_golay.simhash_groups(odd).collect()} == {(r.doc_id, brute_print(r.text)) for r in odd.collect()}
    assert simhash_golay.simhash_groups(empty).count() == 0


def test_simhash_links_lose_none(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, n, replace=False)) for b in base for n in (1, 2, 3, 4)]
    prints = sorted({*map(int, base), *near})
    got = {(r.a, r.b) for r in simhash_golay.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 400)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 400)}


def test_components_of_few_links_take_few_tasks_whatever_the_width(spark):
    """A narrow table isn't cut into as many tasks as the session's shuffles have partitions, round after round."""
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 9000)], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    spark.sparkContext.setJobGroup("few-tasks", "few-tasks")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = {r.node: r.component for r in components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    at = spark.sparkContext.statusTracker()
    stages = {s for j in at.getJobIdsForGroup("few-tasks") for s in at.getJobInfo(j).stageIds}
    tasks = [x.numTasks for s in stages if (x := at.getStageInfo(s)) and x.numCompletedTasks]
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 9000)}
    assert sum(n >= 211 for n in tasks) <= 2  # the links' first table, of which nothing is known before, and its reader


def test_sentencepiece_matches_the_library(odd, empty, docs):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    for table in (odd, docs):
        texts = Counter((r.doc_id, tuple(lib.encode(r.text or ""))) for r in table.collect())
        got = sentencepiece_fst.sentencepiece(table, model).collect()
        assert Counter((r.id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == texts
        assert all(r.decoded == lib.decode(np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert sentencepiece_fst.sentencepiece(empty, model).count() == 0


def test_weights_decide_the_path_of_a_unigram_model(spark, tmp_path):
    """A model written down here, with pieces that overlap everywhere: the tropical shortest path is the library's best one."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng, model, space = np.random.default_rng(11), sentencepiece_model_pb2.ModelProto(), sentencepiece_fst.SPACE
    pieces = {"".join(rng.choice(list("abcé"), rng.integers(2, 6))) for _ in range(150)} | {space + x for x in ("a", "ab", "abc", "b", "ca")} | set("abcé") | {space}
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    kinds += [(p, float(np.float32(-rng.uniform(1, 4) - len(p) * rng.uniform(0.5, 3))), 1) for p in sorted(pieces)]
    for piece, score, kind in kinds:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(rng.choice(list("aabbcé d"), rng.integers(0, 60))) for _ in range(300)] + ["", " ", "  a", "zz", "é" * 40, "abc" * 500]
    machine = sentencepiece_fst.PieceTransducer(str(path))
    weight = lambda ids: -sum(model.pieces[i].score for i in ids)
    greedy = 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece_fst.sentencepiece(docs, str(path)).collect():
        got, want, text = np.frombuffer(r.ids, "<u4").tolist(), lib.encode(texts[r.id]), machine.normalise(texts[r.id])
        assert got == want or abs(weight(got) - weight(want)) < 1e-3, texts[r.id]  # sums in floats may order ties their own way
        assert r.decoded == texts[r.id]
        at, longest = 0, []
        while at < len(text):  # what the longest match would take
            step = max((n for n in range(1, 7) if text[at : at + n] in machine.lexicon), default=1)
            longest.append(machine.lexicon.get(text[at : at + step], -1))
            at += step
        greedy += longest != got
    assert greedy > 100  # weights decide, not lengths


def test_token_frames(spark, odd, empty, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table in (odd, docs):
        index = token_frames.write_frames(table, public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "files"), files=3, frame_bytes=2000)
        got = token_frames.read_frames(token_frames.manifest_of(index)).orderBy("start").collect()
        want = [(r.doc_id, np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in table.collect()]
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(b) // 4, zlib.crc32(b)) for i, b in want)
        assert [r.doc_id for r in got] == sorted((i for i, _ in want), key=lambda i: (i is not None, i))
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
        some = index.where("id in (3, 7, 9)")
        assert {(r.id, len(r.ids)) for r in token_frames.read_documents(some).collect()} == {(i, len(b) // 4) for i, b in want if i in (3, 7, 9)}
    files = token_frames.write_frames(empty, public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "files"))
    same = spark.range(400).selectExpr("cast(if(id % 2 = 0, null, 5) AS long) AS doc_id", "concat('text <|endoftext|> ', id) AS text")
    spread = token_frames.write_frames(same, public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "files"), files=4)
    assert spread.select("file").distinct().count() == 4
    rows = token_frames.read_frames(token_frames.manifest_of(spread)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 200 + [5] * 200 and [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]
    assert token_frames.encoded(odd, public_tokenizers.path("byte_bpe_50k.json")).count() == odd.count()
    assert token_frames.read_frames(token_frames.manifest_of(files)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    out, stopped, left = {}, set(), sum(sizes)
    while True:
        share = sum(weights[i % 3] for i in range(len(sizes)) if i not in stopped)
        over = {i for i in range(len(sizes)) if i not in stopped and left * weights[i % 3] / share > most * sizes[i]}
        if not over:
            return [most * n if i in stopped else left * weights[i % 3] / share for i, n in enumerate(sizes)] if share else [0.0] * len(sizes)
        stopped |= over
        left -= sum(most * sizes[i] for i in over)


def test_targets(spark):
    for sizes in ([10, 10, 10], [1, 1000, 5, 0], [7], [], [100, 1, 1, 1, 50, 300], [0, 0], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]):
        names = [f"s{i:03d}" for i in range(len(sizes))]
        names[-1:] = [None] if names else []  # null comes last
        plan = source_mix.plan_of(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(3)).collect()
        at = {r.source: r for r in plan}
        assert [at[n].place for n in names] == list(range(len(names)))
        found = [at[n].target for n in names]
        assert found == pytest.approx(plain_targets(sizes)) and abs(sum(found) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
        assert all(t <= 3 * n + 1e-9 and at[s].slots <= 3 * at[s].blocks for t, n, s in zip(found, sizes, names))


def test_permutation_and_shard_counts(spark):
    for n in (1, 2, 3, 10, 257, 1000):
        assert sorted(source_mix.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    totals, seen, sizes = np.array([100, 0, 7, 901]), np.zeros(4, int), []
    for shard, some, counts, before in source_mix.shard_counts(totals, 9, [1, 0]):
        assert before.tolist() == seen[some].tolist() and (counts > 0).all()
        seen[some] += counts
        sizes.append(counts.sum())
    assert seen.tolist() == totals.tolist() and len(sizes) == 9 and max(sizes) - min(sizes) <= 1
    # over several runs each source's slots are dealt exactly once, whether it has fewer or more than there are runs
    plan = spark.createDataFrame([(0, 5000, 9000), (1, 3, 7), (2, 1, 1), (3, 1, 0), (4, 40, 120)], "place long, blocks long, slots long")
    got = source_mix.slots_of(plan, slots=16).collect()
    assert len(got) == 9000 + 7 + 1 + 120 and len({(r.shard, r.slot) for r in got}) == len(got)
    uses = Counter((r.place, r.block, r.turn) for r in got)
    assert max(uses.values()) == 1 and all(b < {0: 5000, 1: 3, 2: 1, 4: 40}[p] for p, b, _ in uses)
    by_shard = Counter(r.shard for r in got)
    assert max(by_shard.values()) <= 16 and np.mean([n >= 15 for n in by_shard.values()]) > 0.9


def plain_taken(rows, plan, seed=1):
    """(place, start) -> words taken, by walking every slot of every source."""
    taken = Counter()
    for p in plan:
        uses = Counter()
        for j in range(p.slots):
            key = (seed * 1_000_003 + p.place) * 1_000_003 + j // p.blocks
            uses[int(source_mix.permuted(np.array([j % p.blocks]), p.blocks, key)[0])] += 1
        for r in rows:
            if r.place == p.place and r["size"]:
                taken[r.place, r.start] = sum(uses[w // source_mix.BLOCK_WORDS] for w in range(r.start, r.start + r["size"]))
    return taken


def test_mix(spark, odd, empty, docs):
    for table in (docs.limit(60), odd):
        table = staged(table, "some")
        rows, plan, mixed = source_mix.mix(table)
        sizes = Counter({None: 0})
        for r in table.collect():
            sizes[r.source] += len(WORDS.findall(r.text or ""))
        plans = {r.source: r for r in plan.collect()}
        assert {s: r.source_size for s, r in plans.items()} == {s: n for s, n in sizes.items() if s in plans}
        spans, laid = mixed.collect(), rows.collect()
        assert len(laid) == table.count()
        for s, r in plans.items():  # a source's documents lie end to end
            at = sorted((x.start, x["size"]) for x in laid if x.place == r.place and x["size"])
            assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at]).tolist()][: len(at)]
        taken, by_row = Counter(), Counter()
        places = {r.place: s for s, r in plans.items()}
        for r in spans:
            taken[places[r.place]] += r["last"] - r["first"]
            by_row[r.place, r.start] += r["last"] - r["first"]
        for s, r in plans.items():
            assert abs(taken[s] - r.target) <= 2 * source_mix.BLOCK_WORDS + 0.02 * r.target, (s, taken[s], r.target)
        assert by_row == +plain_taken(laid, plans.values())
        assert all(by_row[r.place, r.start] <= 3 * r["size"] for r in laid if r["size"])
        again = source_mix.mix(table.repartition(3))[2].collect()
        key = lambda r: (r.shard, r.slot, r.id is None, r.id, r.first, r.last)
        assert Counter(map(key, again)) == Counter(map(key, spans))
        copies = source_mix.mixed_documents(table)
        assert copies.columns == table.columns
        assert sum(len(WORDS.findall(r.text)) for r in copies.collect()) == sum(taken.values())
    assert source_mix.mix(empty)[2].count() == 0 and source_mix.mixed_documents(empty).count() == 0


def test_mix_of_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "COPIES", 7)
    table = spark.range(100).selectExpr("id div 50 AS doc_id", "if(id < 50, 'a b c d e', 'f g') AS text", "'s' AS source", "id AS spans")
    rows, plan, mixed = source_mix.mix(table)
    assert sorted((r.id, r.copy) for r in rows.collect()) == [(i, k) for i in (0, 1) for k in range(50)]
    copies = source_mix.mixed_documents(table).collect()
    assert sum(len(r.text.split()) for r in copies) == mixed.selectExpr("sum(last - first)").first()[0] == plan.first().source_size == 350
    assert len({r.spans for r in copies}) == len(copies) == 100


def held_out(spark, operator, label, folds, out):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = operator(docs.select("doc_id", "text"), labels, fold("doc_id", folds) != out)
    rows = found.where(fold("doc_id", folds) == out).join(labels, "doc_id").collect()
    right = sum((r.score >= 0.7) == bool(r[label]) for r in rows)
    return right / len(rows), rows


def test_toxicity_learns(spark):
    accuracy, rows = held_out(spark, toxicity_fm.toxicity, "toxic", 3, 1)
    assert accuracy > 0.97
    assert sum(r.score >= 0.7 for r in rows if r.toxic) > 0.8 * sum(r.toxic for r in rows)


def test_machine_learns_a_pair():
    rows = [[0], [1], [0, 1], []] * 100
    machine = toxicity_fm.fit_machine(np.arange(2), rows, np.array([0, 0, 1, 0] * 100, float), epochs=150)
    assert [s >= 0.5 for s in machine.score([[0], [1], [0, 1], []])] == [False, False, True, False]


def test_quality_learns(spark):
    assert held_out(spark, quality_lsa.quality, "quality", 4, 2)[0] > 0.97


def test_quality_scores_are_exact_votes():
    rng = np.random.default_rng(0)
    x, y = rng.random((60, 128)).astype(np.float32), rng.integers(0, 2, 60)
    model = quality_lsa.fit_model(x, y, rank=8)
    query = rng.random((9, 128)).astype(np.float32)
    z = model.project(query)
    for row, got in zip(z, model.score(query)):
        cosines = (model.vectors @ row).astype(float)
        near = np.argsort(-cosines)[: quality_lsa.NEIGHBOURS]
        weight = np.clip(cosines[near], 1e-3, 1) ** quality_lsa.SHARPNESS
        assert got == pytest.approx((weight * y[near]).sum() / weight.sum(), rel=1e-5)


@pytest.mark.parametrize("operator", [toxicity_fm.toxicity, quality_lsa.quality])
def test_classifiers_on_odd_rows(spark, odd, empty, operator):
    labels = spark.createDataFrame([(5, 1, 1), (14, 0, 0), (3, 0, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = operator(odd, labels, fold("doc_id", 3) >= 0)
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert {r.score for r in operator(odd, labels.limit(0), fold("doc_id", 3) >= 0).collect()} == {0.5}
    assert operator(empty, labels, fold("doc_id", 3) >= 0).count() == 0


def test_chunks_are_cut_and_ids_laid_out_by_arrow(monkeypatch):
    texts = ["", "a b\nc", " lead", "a  b", "a\n", "\n", "x\u3000y z", "a \n b", "\u65e5 b", "a b\nc"]
    lists, places = token_frames.chunk_lists(texts)
    assert sorted(places) == list(range(len(texts)))
    assert all(got == (token_frames.chunks_of(texts[k]) or [""]) for k, got in zip(places, lists.to_pylist()))
    encoder, asked = token_frames.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")), []
    known = encoder._known
    monkeypatch.setattr(encoder, "_known", lambda chunks, firsts: asked.extend(chunks) or known(chunks, firsts))
    assert encoder.encode([]) == [] and len(set(encoder.encode(["a b b c b"] * 50))) == 1
    assert sorted(asked) == ["b", "c"]  # once each, however often they stand in a part


def test_a_new_chunk_costs_few_calls_and_a_known_one_none():
    """Most chunks of a large table are new, so what Python does for each decides the encoder's CPU time."""
    import sys

    encoder, calls = token_frames.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")), []
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(200)]
    for most in (4 * 20_000, 1_000):
        calls.clear()
        sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
        try:
            got = encoder.encode(texts)
        finally:
            sys.setprofile(None)
        assert len(calls) < most
    assert got == [b"".join(np.array(x.ids + [0], "<u4").tobytes() for x in [encoder.lib.encode(t, add_special_tokens=False)]) for t in texts]


def test_chunk_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, encoder, rng = Tokenizer.from_file(path), token_frames.ChunkEncoder(path), random.Random(5)
    texts = ["", " ", "\n", "a<|endoftext|> b", "a <|endoftext|>b", " lead", "trail  ", "\n\na\nb \n c", "a\x1cb c\x1fd", "it's don't' x''s l'' a'S. b.' D'] ok.)\"", "\u2167. \u00aa. \u02b0. x\u00b2, \u0250."]
    texts += ["".join(rng.choices("ab \n\t\r\u3000\x1c'1\u00e9\u65e5<|>.s-)", k=rng.randint(0, 30))) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids == np.array([*lib.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
