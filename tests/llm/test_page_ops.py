"""HTML extraction, WARC bundles, vectors and the pipeline."""

import hashlib
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import embedding_passes, host_suffix, warc_bundles
from brindle.llm.common import fresh_path, staged

SF = "/root/testdata/sf0.001"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


ARTICLE = page("<nav><a href=x>Home</a></nav><div class=ad>Buy</div><article><header><h1>Head &amp; line</h1>by me</header><p>One <b>two\n three<p>Four<br>five</p><aside>side</aside><script>var a='</p>';</script></article><div id=comments><p>I say</p></div><footer>foot")


def test_article_blocks():
    text, stream = host_suffix.split_page(ARTICLE)
    assert text == ["Head & line One two three Four five"]
    assert stream == "0Home\n0Buy\nA\n0by me\nA\n0side\n0I say\n0foot"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a<p>b &lt;c&gt; &#233;<!-- no -->", "a b <c> é"),
        (page("<main><p>in main</p></main><p>out</p>"), "in main"),
        (page("<div role=navigation>menu</div><div style='display: none'>x</div><p hidden>y</p><p>kept</p>"), "kept"),
        (page("<p title='a > b'>quoted</p><p class=\"unclosed>tail"), "quoted tail"),
        (page("<article class=comment>no</article><p>yes</p>"), "yes"),
        (page("<form><p>f</p></form><div class='cookie-banner'>c</div><div class='with-sidebar'>kept</div><textarea>t</textarea>"), "kept"),
        ("<article><p>cut &am", "cut &am"),
        (page('<article class="post comments-open"><p>kept</p></article><div class="ad">no</div>'), "kept"),
        (page('<article class="share-buttons-enabled"><p>kept</p></article>'), "kept"),
        (page('<article class="ad-free"><p>kept</p></article>'), "kept"),
        (page('<article><p>a</p><div id="related-work"><p>b</p></div><p>c</p></article>'), "a b c"),
        (page('<article><section id="comments-on-theory"><p>b</p></section><div class="social-studies">d</div></article>'), "b d"),
        (page('<article><p>a</p><div class="related-posts">no</div><div class="share-buttons">no</div><article class="post comment">no</article><p>b</p></article>'), "a b"),
    ],
)
def test_small_pages(html, text):
    article, stream = host_suffix.split_page(html)
    found = host_suffix.with_doubted(article, stream, None) if article is not None else host_suffix.decide(stream, None, None)
    assert found == text


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<p>a</p><svg/><p>b</p>", "a b"),
        ("<p>a</p><svg viewBox='0 0 1 1' /><p>b</p><svg><text>no</text></svg><p>c</p>", "a b c"),
        ("<p>a <math/> b</p>", "a b"),
        ("<p>a</p><svg><svg/><svg><text>no</text></svg><text>no</text></svg ><p>b</p>", "a b"),
    ],
)
def test_self_closed_and_nested_svg(inner, text):
    assert host_suffix.split_page(page(f"<article>{inner}</article>"))[0] == [text]


def test_doubted_blocks_of_articles_go_by_the_array(spark, monkeypatch):
    """A block whose class only half speaks for furniture stays, unless its words repeat on its host."""
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    same, rows = "all of the other stories that we have told you about this week in one place", []
    for i in range(12):
        rows.append((i, f"http://one.example/{i}", page(f'<article><p>{words(i, 40)}</p><div class="related-stuff">{same}</div><div id="related-work">{words(i + 100, 20)}</div><p>end {i}</p></article>')))
    rows.append((50, "http://two.example/", page(f'<article><p>alone</p><div class="related-stuff">{same}</div></article>')))
    pages = spark.createDataFrame([(*r, 1, "n", "s") for r in rows], "page_id long, url string, html string, number int, host string, stream string")
    got = {r.id: r.text for r in host_suffix.main_texts(pages).collect()}
    assert got == {i: f"{words(i, 40)} {words(i + 100, 20)} end {i}" for i in range(12)} | {50: f"alone {same}"}
    monkeypatch.setattr(host_suffix, "repeats", lambda array: array.sparkSession.createDataFrame([], "part long, run long, whole long"))
    got = {r.id: r.text for r in host_suffix.main_texts(pages).collect()}
    assert all(same in text for text in got.values())


def test_deep_and_unmatched_tags_take_linear_time():
    for html in ("<div>" * 100_000 + "</p>" * 100_000 + "x", "<b><div>" * 50_000 + "</b>" * 100_000 + "x", "<svg>" * 50_000 + "</div>" * 50_000, "<li>x" * 50_000, "&lt;" * 200_000 + "<" * 50_000):
        began = time.perf_counter()
        host_suffix.split_page(html)
        assert time.perf_counter() - began < 5


def brute_repeats(pages, depth):
    """(host, stream, place) of each run of depth words that stands on two pages of its host with different texts."""
    seen = {}
    for host, stream, text in pages:
        row = stream.split()
        for i in range(len(row) - depth + 1):
            seen.setdefault((host, tuple(row[i : i + depth])), set()).add((stream, i, text))
    return {(k[0], stream, i) for k, at in seen.items() if len({t for *_, t in at}) > 1 for stream, i, _ in at}


@pytest.mark.parametrize("width", [1, 3, 40])
def test_suffix_array_finds_what_brute_force_finds(spark, monkeypatch, width):
    monkeypatch.setattr(host_suffix, "shuffle_width", lambda spark: width)
    rng = np.random.default_rng(width)
    pages = [(f"h{i % 2}", " ".join("abc"[int(x)] for x in rng.integers(0, 3, 60)), i % 5) for i in range(12)]
    pages += [("h0", pages[0][1], 9), ("h2", "a b c d e f g", 1), ("h2", "a b c d e f g", 1), ("h3", "short", 1), ("h3", "", 2)]
    rows = [(h, "1" + t, *[m] * 3) for h, t, m in pages]
    marked = spark.createDataFrame(rows, "host string, stream string, m0 long, m1 long, m2 long")
    array = host_suffix.suffix_array(host_suffix._ends(marked, ["host", "stream"], "m", "m"), 4)
    names = {int(np.uint64(xxhash.xxh64_intdigest(f"{h}\n1{t}")).view(np.int64)): (h, t) for h, t, _ in pages}
    got = {(*names[r.stream], r.place) for r in host_suffix.covered_places(array).collect()}
    assert got == brute_repeats(pages, 4) and got
    order = [(r.part, r.h, bytes(r.key), r.stream, r.place) for r in array.orderBy("part").collect()]
    assert [x[1:] for x in sorted(order, key=lambda x: x[0])] == sorted(x[1:] for x in order)


def test_hosts_decide_where_structure_is_silent(spark):
    menu = "home news sport weather shop about help contact us now"
    rows = [(i, f"http://a.example/{i}", page(f"<div>{menu}</div><div>story number {i} has words of its own {'x' * i} and more</div>")) for i in range(1, 6)]
    rows += [(9, "http://b.example/9", page(f"<div>{menu}</div><div>alone here</div>")), (10, None, None), (11, "", "")]
    rows += [(20, "http://a.example/20", rows[0][2]), (20, "http://a.example/20", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in host_suffix.main_texts(pages).collect()}
    for i in range(1, 6):
        assert got[i] == f"story number {i} has words of its own {'x' * i} and more"
    assert got[20] == got[1] and got[9] == f"{menu} alone here" and got[10] == got[11] == ""
    assert host_suffix.main_texts(pages).count() == len(rows)
    assert host_suffix.main_texts(pages.limit(0)).count() == 0


def test_array_alone_tells_text_from_furniture(spark):
    """No tag names anything here: the text of each page is what stands between the host's menu and footer."""
    words = iter(np.random.default_rng(8).permutation([f"w{i}" for i in range(9000)]).tolist())
    body = lambda n: " ".join(next(words) for _ in range(n))
    menu, notice, footer, related, passage = (body(n) for n in (9, 14, 20, 12, 36))
    rows, want = [], {}
    for i in range(12):
        blocks = [f"Title {body(3)}", body(40), passage if i % 4 == 0 else body(30), body(12), body(25)]
        items = "".join(f"<li>{w}</li>" for w in menu.split())
        inner = "".join(f"<p>{b}</p>" for b in blocks[:3]) + f"<div>{related}</div>" + "".join(f"<p>{b}</p>" for b in blocks[3:])
        rows.append((i, "https://u@Host.example:8080/x", page(f"<ul>{items}</ul><div>{notice}</div><div>{inner}</div><div>{footer}</div>")))
        want[i] = " ".join(blocks)
    rows += [(20 + i, f"http://other{i}.example/", page(f"<div>{menu}</div><p>{body(30)}</p>")) for i in range(3)]
    found = host_suffix.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r.id: r.text for r in found}
    assert {i: got[i] for i in want} == want
    assert all(got[20 + i].startswith(menu) for i in range(3))  # one page a host: nothing repeats
    counts = host_suffix.repeated_blocks(spark.createDataFrame(rows[:12], "page_id long, url string, html string")).collect()
    assert sorted((r.id, r.sign, r.repeated) for r in counts) == [(i, "1", 12 + (i % 4 == 0)) for i in range(12)]


def test_article_elements_renamed_change_nothing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    tagged = {r.id: r.text for r in host_suffix.main_texts(pages).collect()}
    assert {r.id: r.text for r in host_suffix.main_texts(renamed).collect()} == tagged


def test_hosts_leave_near_copies_and_shared_passages(spark):
    menu = "home news sport weather shop about help contact us now"
    words = iter(np.random.default_rng(4).permutation([f"w{i}" for i in range(3000)]).tolist())
    body = lambda n: " ".join(next(words) for _ in range(n))
    story, passage, other, own = body(120), body(60), [body(50) for _ in range(6)], [body(90), body(80)]
    near = story.replace(story.split()[60], "changed")
    rows = [(1, "http://two/1", page(f"<div>{story}</div>")), (2, "http://two/2", page(f"<div>{near}</div>"))]
    rows += [(3, "http://m/3", page(f"<div>{menu}</div><div>{story}</div>")), (4, "http://m/4", page(f"<div>{menu}</div><div>{near}</div>"))]
    rows += [(5 + i, f"http://m/{5 + i}", page(f"<div>{menu}</div><p>{own[i]}</p><p>{passage}</p>")) for i in range(2)]
    rows += [(7 + i, f"http://m/{7 + i}", page(f"<div>{menu}</div><p>{other[i]}</p>")) for i in range(3)]
    got = {r.id: r.text for r in host_suffix.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: story, 2: near, 3: story, 4: near, 5: f"{own[0]} {passage}", 6: f"{own[1]} {passage}", **{7 + i: other[i] for i in range(3)}}


def test_array_holds_the_words_of_articles(spark):
    """Passages that articles share are repeats of the array, and stay; a page without repeats has none."""
    words = iter(np.random.default_rng(6).permutation([f"w{i}" for i in range(3000)]).tolist())
    body = lambda n: " ".join(next(words) for _ in range(n))
    passage, own = body(30), [body(40) for _ in range(7)]
    rows = [(i, "http://a.example/", page(f"<nav>{body(10)}</nav><article><p>{own[i]}</p>{f'<p>{passage}</p>' * (i < 6)}</article>")) for i in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = {(r.id, r.sign): (r.blocks, r.repeated) for r in host_suffix.repeated_blocks(pages).collect()}
    assert counts == {(i, "0"): (1, 0) for i in range(7)} | {(i, "A"): (2, 1) for i in range(6)} | {(6, "A"): (1, 0)}
    assert {r.id: r.text for r in host_suffix.main_texts(pages).collect()} == {i: " ".join([own[i], passage][: 1 + (i < 6)]) for i in range(7)}


def test_array_overrules_an_article_that_is_boilerplate(spark, monkeypatch):
    """A promotion in an article element on every page of a host isn't the text beside the page's own words; where the array
    finds no repeats, or few, the element's tag decides."""
    words = iter(np.random.default_rng(7).permutation([f"w{i}" for i in range(3000)]).tolist())
    body = lambda n: " ".join(next(words) for _ in range(n))
    promotion, own = body(14), [body(60) for _ in range(12)]
    rows = [(i, f"http://{'a' if i < 8 else 'b'}.example/{i}", page(f"<article><p>{promotion}</p></article><div><p>{own[i]}</p></div>")) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in host_suffix.main_texts(pages).collect()}
    assert got == {i: own[i] if i < 8 else promotion for i in range(12)}
    monkeypatch.setattr(host_suffix, "repeats", lambda array: array.sparkSession.createDataFrame([], "part long, run long, whole long"))
    assert {r.text for r in host_suffix.main_texts(pages).collect()} == {promotion}


@pytest.mark.parametrize("opened", [False, True])
def test_evidence_against_brute_force(spark, monkeypatch, opened):
    """The places of repeats and of boilerplate, through sieve, pieces, array and counts; hosts that don't ask lack rare repeats."""
    monkeypatch.setattr(host_suffix, "SHARE", 0.2)
    rng = np.random.default_rng(3)
    bank = [" ".join(f"p{i}x{j}" for j in range(int(rng.integers(9, 40)))) for i in range(12)]
    rows = []
    for i in range(60):
        blocks = [" ".join("abcdefgh"[int(x)] for x in rng.integers(0, 8, 25)), *(bank[int(x)] for x in rng.integers(0, 1 + i % 12, 3)), f"own {i} " * 5]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append((i, f"http://h{i % 2}/", page(body if opened else f"<nav>{bank[i % 12]}</nav><article>{body}</article>")))
    found = host_suffix._rows(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")
    parts = host_suffix._parsed(found, 8)
    marks = {r.number: tuple(r[x] for x in host_suffix.SKETCH) for r in parts.collect()}
    got = {r.number: (set(r.repeated), set(r.common)) for r in host_suffix._evidence(parts, 8).collect()}
    at, hosts, times = {}, {}, {}
    words = {r.number: (r.host, [w for _, t in host_suffix.lines_of(r.html) for w in t.split()]) for r in found.collect()}
    for number, (host, row) in words.items():
        hosts.setdefault(host, set()).add(marks[number])
        for j in range(len(row) - 7):
            key = (host, *row[j : j + 8])
            at.setdefault(key, set()).add(marks[number])
            times[key] = times.get(key, 0) + 1
    apart = lambda pages: min(len(set(x)) for x in zip(*pages))
    often = {k for k, v in at.items() if apart(v) >= max(5, -(-apart(hosts[k[0]]) // 5))}
    assert often and len(often) < sum(len(v) > 1 for v in at.values())
    for number, (host, row) in words.items():
        keys = {j: (host, *row[j : j + 8]) for j in range(len(row) - 7)}
        repeated, common = got.get(number, (set(), set()))
        assert common == {j for j, k in keys.items() if k in often}
        want = {j for j, k in keys.items() if apart(at[k]) > 1}
        assert repeated == want if opened else {j for j in want if times[keys[j]] >= 5} <= repeated <= want


@pytest.mark.parametrize("width", [1, 3, 40])
def test_sieve_drops_no_repeat(spark, monkeypatch, width):
    monkeypatch.setattr(host_suffix, "shuffle_width", lambda spark: width)
    monkeypatch.setattr(host_suffix, "CHUNK", 100)
    rng = np.random.default_rng(width)
    texts = [(f"h{i % 2}", " ".join("abcdef"[int(x)] for x in rng.integers(0, 6, 50))) for i in range(40)] + [("h2", None), ("h2", "a b c"), ("h3", "x " * 9)]
    rows = spark.createDataFrame([(h, t and f"<article>{t}</article>") for h, t in texts] + [("h0", "no article")], "host string, html string")
    bits, times = host_suffix.sieve(rows, 4), {}
    for h, t in texts:
        for k in host_suffix._keys(h, host_suffix.tokens_of(host_suffix.bytes_of([("A", t.strip())] if t else []))[0], 4).tolist():
            times[k] = times.get(k, 0) + 1
    assert sum(n == 1 for n in times.values()) > 100 and any(n >= 5 for n in times.values())
    for k, n in times.items():
        assert [bool(host_suffix._bit(x, np.array([k], np.uint64))[0]) for x in bits] == [n > 1, n >= 5]
    assert [bool(host_suffix._bit(bits[0], host_suffix._flag(h))[0]) for h in ("h0", "h1", "h2", "h3")] == [True, False, False, False]


def test_pages_table_matches_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    got = {r.id: r.text for r in host_suffix.main_texts(pages).collect()}
    import html as entities

    for r in pages.collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        want = " ".join(x for x in (" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)) if x)
        assert got[r.page_id] == want


def test_warc(spark):
    long = "x" * 150
    rows = [(4, "u", long), (2, "u\r\nv", long), (7, None, "short"), (1, "w", "short"), (9, "w", None), (3, "w", "é" * 60), (8, "w", "é" * 60), (2, "u\r\nv", long), (None, "z", long), (5, "q", "\r\n\r\nWARC/1.1" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_bundles.write_bundles(warc_bundles.classified(pages), fresh_path(spark, "warc"), frame_bytes=300)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundles.read_bundles(index).collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "").encode() == body and j is not None), default=None)
        revisit = len(body) >= 100 and first is not None and i != first
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    one = warc_bundles.read_records(index.where("id = 3")).collect()
    assert [(r.id, r.kind, bytes(r.payload).decode()) for r in one] == [(3, "response", "é" * 60)]
    none = warc_bundles.write_bundles(warc_bundles.classified(pages.limit(0)), fresh_path(spark, "warc"))
    assert warc_bundles.read_bundles(none).count() == 0


def test_warc_sketch_lets_revisits_through_and_few_others(spark):
    pages = spark.range(4000).selectExpr("id", "sha2(cast(id as string), 256) as digest")
    revisits = pages.where("id % 20 = 0").unionByName(spark.createDataFrame([(None, "d")], "id long, digest string"))
    sketch = warc_bundles.sketch_of(revisits.select(warc_bundles.bit_of(F.col("id"), F.col("digest")).alias("bit")))
    rows = pages.unionByName(revisits.where("id is null"))
    found = warc_bundles.marked(rows, sketch).collect()
    through = {r.id for r in found if r.maybe}
    assert len(found) == 4001 and through >= {None, *range(0, 4000, 20)} and len(through) < 210
    none = warc_bundles.marked(rows, sketch.limit(0)).where("maybe")
    assert none.count() == 0


def test_warc_without_broadcasts(spark):
    pages = spark.createDataFrame([(i, "u", ("y" * 200 if i % 50 == 7 else f"page {i} ") * 20) for i in range(500)], "page_id long, url string, html string")
    of = lambda: sorted(warc_bundles.classified(pages).select("id", "revisit", F.coalesce("refers_to", F.lit(-1))).collect())
    want, threshold = of(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert [r.id for r in want if r.revisit] == list(range(57, 500, 50))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert of() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(600)]
    for c in range(30):
        centre = rng.normal(size=32)
        vectors += [(1000 + 40 * c + j, (centre + 0.12 * rng.normal(size=32)).astype(np.float32).tolist()) for j in range(int(rng.integers(2, 40)))]
    same = rng.normal(size=32).astype(np.float32).tolist()
    vectors += [(5000 + i, same) for i in range(300)]
    bad = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] + [1.0] * 31), (9003, []), (9004, same[:31]), (9005, [None] + same[1:]), (9006, [float("inf")] * 32)]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>")
    got = {r.id: r for r in embedding_passes.embedding_groups(frame).collect()}
    ids, x = [i for i, _ in vectors], np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(close, 1))):
        p, q = sorted((root(ids[a]), root(ids[b])))
        up[q] = p
    links = close.sum(1) - 1
    assert sum(got[i].n_links for i in ids) >= 0.99 * links.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, links))
    assert np.mean([got[i].component_id == root(i) for i in ids]) >= 0.99
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, _ in bad if i != 9004)
    assert embedding_passes.embedding_groups(frame.limit(0)).count() == 0


def test_embeddings_count_links_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(embedding_passes, "EDGE", (16, 16))
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.2 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(150)]
    got = {r.id: r.n_links for r in embedding_passes.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: int(n) for i, n in enumerate((x @ x.T >= 0.95).sum(1) - 1)}


def test_block_pairs_are_dealt_by_component_and_blocks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = staged(spark.createDataFrame([(1, i, [1.0, 0.0], 1) for i in range(40)], "component long, node long, v array<float>, m long"), "members")
        sizes = staged(spark.createDataFrame([(1, 40)], "component long, size long"), "sizes")
        counts = embedding_passes.link_counts(members, sizes, 40)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        grouped = plan[plan.index("FlatMapGroupsInArrow") :]
        assert re.match(r"hashpartitioning\(component#\d+L?, lo#\d+, hi#\d+", grouped[grouped.index("hashpartitioning") :])
        assert {r.n for r in counts.collect()} == {39}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def hot_cone(n, pairs, cone, cosine=0.955, size=64):
    """n vectors of this mean cosine and, for the first of them, a partner each at just over the threshold."""
    rng = np.random.default_rng(1)

    def sphere(k):
        x = rng.normal(size=(k, size - 1))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x, y = sphere(n), sphere(pairs)
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (cosine - cone) / (1 - cone)
    x = np.sqrt(1 - cone) * np.vstack([x, near * x[:pairs] + np.sqrt(1 - near**2) * y])
    return np.hstack([np.full((n + pairs, 1), np.sqrt(cone)), x]).astype(np.float32)


def found_pairs(spark, x, n, pairs):
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    at = {r.id: r.component_id for r in embedding_passes.embedding_groups(frame).collect()}
    return np.mean([at[i] == at[n + i] for i in range(pairs)]), at


def test_embeddings_find_isolated_pairs_in_a_hot_cone(spark):
    assert found_pairs(spark, hot_cone(12000, 300, 0.85), 12000, 300)[0] >= 0.99


@pytest.mark.parametrize("cone", (0.0, 0.6))
def test_passes_against_brute_force(spark, cone, monkeypatch):
    """Thousands of vectors through the passes alone: all links of all components."""
    monkeypatch.setattr(embedding_passes, "block_links", None)
    x = np.vstack([hot_cone(6000, 500, cone), hot_cone(300, 300, 0.97, 0.985)])  # pairs and a dense ball
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = {r.id: r.n_links for r in embedding_passes.embedding_groups(frame).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    given = np.array([got[i] for i in range(len(x))])
    assert (given <= links).all() and given.sum() >= 0.99 * links.sum()


def test_plans_reach_their_recall_or_are_exact():
    for cone, nodes in ((0.0, 10**6), (0.85, 10**6), (0.85, 10**8), (0.92, 10**5), (0.92, 10**9)):
        x = hot_cone(4096, 0, cone).astype(float)
        found = embedding_passes.plan(x / np.linalg.norm(x, axis=1, keepdims=True), nodes)
        assert found.recall >= embedding_passes.RECALL
        assert found.exact or found.passes * (found.window + embedding_passes.PER_PASS) <= max(nodes / 2, embedding_passes.ROUND * (96 + embedding_passes.PER_PASS))


def test_pruned_blocks_lose_no_link(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24)) * 2
    x = np.vstack([centres[i % 30] + 0.5 * rng.normal(size=24) for i in range(2500)]).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(3000 + i, v[:20]) for i, v in enumerate(x[:200].tolist())]
    nodes = staged(spark.createDataFrame(rows, "node long, v array<float>"), "nodes")
    links = {tuple(sorted((r.a, r.b))) for r in embedding_passes.block_links(nodes, embedding_passes.sampled(nodes, 2700), 2700).collect()}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def united(pairs):
        for i in up:
            up[i] = i
        for a, b in pairs:
            p, q = sorted((root(a), root(b)))
            up[q] = p
        return {i: root(i) for i in up}

    want = []
    for part in (rows[:2500], rows[2500:]):
        unit = np.array([v for _, v in part], float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        want += [(part[a][0], part[b][0]) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))]
    assert len(want) > 1000 and links <= set(want)
    assert united(links) == united(want)


def test_embeddings_do_not_depend_on_partitions(spark, monkeypatch):
    x, found = hot_cone(3000, 300, 0.8), []
    for width in ("4", "200"):
        monkeypatch.setattr(embedding_passes, "shuffle_width", lambda spark, width=int(width): width)
        found.append(found_pairs(spark, x, 3000, 300))
    assert found[0] == found[1] and found[1][0] >= 0.99


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in pipeline.STAGES:
        before, at = at, staged(stage(spark, at, SF), "stage")
        if name != "sentencepiece":
            assert at.columns == docs.columns
        if name == "exact dedup":
            texts = [re.sub("[A-Z]+", lambda m: m[0].lower(), r.text) for r in at.collect()]
            assert len(texts) == len(set(texts)) == len({re.sub("[A-Z]+", lambda m: m[0].lower(), r.text) for r in before.collect()})
    assert at.count() > 0
    assert sorted(pipeline.run(spark, SF).select("doc_id", "n_pieces").collect()) == sorted(at.select("doc_id", "n_pieces").collect())
    odd = spark.createDataFrame([(1, None, None, None, None, "e"), (2, "", "en", "s", 0, "e"), (2, "", "en", "s", 0, "e"), (3, "a b c d", "en", "s", 7, "e")], docs.schema.add("score", "string"))
    for rows in (odd, odd.limit(0)):
        at = rows
        for name, stage in pipeline.STAGES:
            at = staged(stage(spark, at, SF), "stage")
        assert at.count() <= rows.count() * 3


def test_near_copies_go_by_row_where_ids_are_null_or_reused(spark):
    import corpus_pipeline as pipeline

    words = np.random.default_rng(3).permutation([f"w{i}" for i in range(4000)]).tolist()
    texts = [" ".join(words[200 * i : 200 * i + 200]) for i in range(12)]
    upper = texts[0].upper()  # the same fingerprint as texts[0]
    rows = [(1, texts[0]), (None, upper), (None, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (7, texts[4]), (7, texts[5]), (8, texts[6]), (9, texts[7]), (9, texts[6]), (None, texts[8].upper()), (None, texts[8])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text.lower()) for r in pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    want = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[5]), (8, texts[6]), (9, texts[7]), (None, texts[8])]
    assert got == sorted(want, key=str)
    assert pipeline.drop_near_copies(spark, docs, SF).columns == docs.columns
