"""Main text of web pages by a suffix array of each host's pages, with page structure to break ties.

A page is cut into blocks, and all words of all blocks are its token stream. The streams of a host are concatenated (equal
runs once), and their suffixes of `MIN_WORDS` words are sorted by host and words: rows dealt by range, so that a host spans
as many tasks as it needs. Neighbours whose common prefix has all those words form an interval, which goes on over the
borders of tasks; an interval with suffixes of several distinct pages is a repeat, and longer repeats are runs of such
intervals. Repeats go back to their pages by offset, where they cover words. Near copies count as one page: pages are told
apart by three least hashes of the runs of their article or, where that is longer, their longest open block.

Most words stand once on their host. A sieve (`sieve`) tells them before the sort: keys of all runs of all pages meet sorted,
and only what may be a repeat goes into the array. Where no page of a host asks for more (`_asks`), that is what stands
`MIN_PAGES` times, since rarer repeats decide nothing there; else it is what stands twice. Nothing that a text may turn on
is dropped; pages are parsed three times instead of being staged.

Page structure says what each block may be: blocks inside an article (or, failing that, a main element) are its text; blocks
in menus, headers, footers, sidebars, forms, notices, adverts and comments are furniture; the others are open. Then the array
decides (`kept_words`), on every page. Repeats that stand on `SHARE` of the host's distinct pages are boilerplate; rarer ones
are passages that articles share, and stay.

- An article of which three quarters are boilerplate, beside more open words that aren't, is furniture of its host (a
  promotion on every page), and the page's text is in its open blocks. Else tags break the tie: the text is the article,
  whole, as passages within it that other pages repeat can't be told from its own.
- A class alone drops an element if all of its parts speak for furniture (`related-posts`, `ad`). An article or main element
  isn't dropped for its class, unless that is all its class says, or it lies in another article. Where only a part speaks for
  it (`related-work`, `comments-on-theory`), a block within an article is doubted: it goes if its words repeat on the host.
- Without an article, the text is the stretch of open blocks that holds most of the page's own words: blocks around it that
  boilerplate covers for the most part go, menus, notices and footers that no tag names; within the stretch only its runs
  themselves go, and all other words stay. A page's longest open block is its text whatever repeats it, and so is a covered
  run of more than half of its open words.

Defined results: a null or empty page has an empty text; pages with equal longest texts count as one page, so copies don't
make each other boilerplate; a page of whose open words nothing would be left keeps them all (it is a copy, not furniture); a
cut-off page ends where its html ends; a null url is a host of its own; repeated rows are extracted each; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import hot_join, load, shuffle_width, staged

#: Words that suffixes are sorted by: a repeat has so many at least.
MIN_WORDS = 8
#: Boilerplate stands on so many distinct pages of its host at least, and on such a share of them.
MIN_PAGES = 5
SHARE = 0.5
SKETCH = tuple(f"s{i}" for i in range(3))
#: Bits of the key of a run, bytes that hold a gap between keys, bits of the sieve's size (16 MB), keys sorted at once.
KEY_BITS, GAP_BYTES, SIEVE_BITS, CHUNK = 38, 5, 27, 1 << 21

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select datalist title textarea".split())
#: Those of them that a slash closes.
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav menu header footer aside form button dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification"
    " pagination popup promo promoted promotion recommended related respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: Name parts that say nothing against a furniture word beside them: `related-posts` is furniture, `related-work` may not be.
BESIDE = frozenset(
    "area articles bar block body bottom box button buttons container content entry fixed form group header icons inner item items left link links list main media module network overlay page panel post posts"
    " section side site slot small sticky thread title top unit wrap wrapper right row".split()
)
QUALIFIED = frozenset("with has no without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop|aria-", re.I)
ARTICLE, MAIN, OPEN, DROPPED = 3, 2, 1, 0
#: What a class says: furniture, perhaps furniture, an article with a class of furniture (comments are marked up so).
NAMED, DOUBTED, ARTICLE_NAMED = -10, -11, -12


def _verdict(tag: str, attributes: str) -> int | None:
    """What an element says of its contents: DROPPED, NAMED (by its class alone), DOUBTED (by a part of its class), MAIN,
    ARTICLE, or None (nothing)."""
    if tag in FURNITURE:
        return DROPPED
    found = MAIN if tag == "main" else ARTICLE if tag == "article" else None
    if not attributes or not _TELLING.search(attributes):
        return found
    fields = {m[1].lower(): next((entities.unescape(x) for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in fields or fields.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", fields.get("style", ""), re.I):
        return DROPPED
    roles = set(fields.get("role", "").lower().split())
    if roles & ROLES:
        return DROPPED
    marks = []
    if tag not in ("html", "body", "main"):
        for name in f"{fields.get('class', '')} {fields.get('id', '')}".split():
            parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            tells = parts and not QUALIFIED.intersection(parts) and (parts[0] in NAMES or parts[-1] in NAMES)
            marks.append((NAMED if all(x in NAMES or x in BESIDE for x in parts) else DOUBTED) if tells else None)
    named = max(filter(None, marks), default=None)
    own = MAIN if "main" in roles else ARTICLE if "article" in roles or fields.get("itemprop", "").lower() == "articlebody" else found
    if own is None or (marks and all(m == NAMED for m in marks)):
        return named if marks else own
    return ARTICLE_NAMED if own == ARTICLE and named == NAMED else own


def _foreign_end(tag: str, page: str, at: int) -> int:
    """Where an svg or math element ends whose contents begin at a place: at its own end tag, after those nested in it."""
    depth = 1
    for m in _TOKEN.finditer(page, at):
        if (m[2] or m[5] or "").lower() == tag and not (m[3] or m[6] or "").endswith("/"):
            depth += -1 if m[1] or m[4] else 1
            if not depth:
                return m.end()
    return len(page)


def blocks_of(page: str) -> list[tuple[int, str, bool]]:
    """(verdict, text, doubted) of each block of a page in order, its white space turned into single spaces."""
    out: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, the verdict inside them and whether it is doubted
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    open_blocks: list[int] = []
    pieces: list[str] = []
    at, end, verdict, doubted = 0, len(page), OPEN, False
    search = _TOKEN.search

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            places[name].pop()
            if name in BLOCK:
                open_blocks.pop()

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((verdict, text, doubted))

    while at < end:
        m = search(page, at)
        if not m:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in RAW and not closing:
            if tag not in FOREIGN:
                closed = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closed.end() if closed else end
            elif not (m[3] or m[6] or "").endswith("/"):
                at = _foreign_end(tag, page, at)
            continue
        if tag in BLOCK:
            flush()
        if closing:
            depth = places[tag][-1] if places.get(tag) else None
            if depth is not None and (tag in BLOCK or not open_blocks or open_blocks[-1] < depth):
                close(depth)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_blocks and stack[open_blocks[-1]][0] == tag:
                close(open_blocks[-1])  # these end the one before them
            said, doubt = _verdict(tag, m[3] or m[6] or ""), doubted
            if said == ARTICLE_NAMED:  # an article within an article may be a comment; else its class doesn't count
                said = DROPPED if abs(verdict) == ARTICLE else ARTICLE
            elif said == DOUBTED:
                said, doubt = None, doubted or abs(verdict) >= MAIN
            elif said == NAMED:
                said = DROPPED
            if verdict == DROPPED or said is None:
                inner = verdict
            elif said == DROPPED and tag == "header" and verdict >= MAIN:
                inner = -verdict  # an article's own header: its headings count
            else:
                inner = DROPPED if said == DROPPED else max(said, abs(verdict))
            if inner < 0 and tag in HEADINGS:
                inner = -inner
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                open_blocks.append(len(stack))
            stack.append((tag, inner, doubt))
        now = stack[-1][1:] if stack else (OPEN, False)
        if now != (verdict, doubted):
            flush()
            verdict, doubted = now
    flush()
    return out


#: The signs of a stream's lines: furniture, open, doubted blocks of an article, and its other words.
FURNISHED, UNDECIDED, UNSURE, TEXT = "0", "1", "2", "A"


def lines_of(page: str | None) -> list[tuple[str, str]]:
    """(sign, text) of every block of a page in order."""
    blocks = blocks_of(page) if page else []
    best = max((v for v, *_ in blocks), default=OPEN)
    return [((UNSURE if doubt else TEXT) if v == best >= MAIN else FURNISHED if v <= DROPPED else UNDECIDED, t) for v, t, doubt in blocks]


def stream_of(page: str | None) -> str:
    """The stream of a page, all that goes into the array: a line a block, after its sign."""
    return "\n".join(sign + t for sign, t in lines_of(page))


def split_page(page: str | None) -> tuple[list[str] | None, str]:
    """The tags' reading alone, without the array: (the article's text in pieces between its doubted blocks, or None if the
    page has none; the other blocks and the doubted ones, a line with its sign each, and a mark where the article stands)."""
    found = lines_of(page)
    if all(sign in (FURNISHED, UNDECIDED) for sign, _ in found):
        return None, "\n".join(sign + t for sign, t in found)
    pieces, lines = [[]], []
    for sign, t in found:
        if sign == UNSURE:
            pieces.append([])
            lines.append(sign + t)
        elif sign == TEXT:
            pieces[-1].append(t)
            lines += [TEXT] * (lines[-1:] != [TEXT])
        else:
            lines.append(sign + t)
    return [" ".join(p) for p in pieces], "\n".join(lines)


def with_doubted(pieces: list[str], stream: str, repeated: list[int] | None, depth: int = MIN_WORDS) -> str:
    """The tags' reading with its doubted blocks, unless they repeat in three quarters of their words."""
    lines = [x for x in stream.split("\n") if x]
    sizes = [1 if x == TEXT else len(x[1:].split()) for x in lines]
    shared, at, out, left = _cover(repeated or [], sum(sizes), depth), 0, [pieces[0]], iter(pieces[1:])
    for line, size in zip(lines, sizes):
        if line[0] == UNSURE:
            out += [line[1:]] * (4 * int(shared[at : at + size].sum()) <= 3 * size) + [next(left)]
        at += size
    return " ".join(x for x in out if x)


def words_of(stream: str) -> list[str]:
    """The words of a stream; the mark of an article's place counts as one."""
    return [w for line in stream.split("\n") if line for w in ([line] if line == TEXT else line[1:].split())]


def _hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w)
    return np.array([memo[w] for w in words], np.uint64)


_BYTES, _POWERS = (np.random.default_rng(i).integers(1, 1 << 63, 1 << bits, np.uint64) | np.uint64(1) for i, bits in ((1, 8), (2, 10)))
_BYTES[32] = 0


def tokens_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, where it starts, and the end) of the UTF-8 bytes of words with single spaces between them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(data == 32) + 1, [len(data) + 1]))
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))[: len(data)]
        out = np.add.reduceat(_BYTES[data] * _POWERS[place & 1023], starts[:-1])
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32), starts


def bytes_of(lines: list[tuple[str, str]]) -> np.ndarray:
    return np.frombuffer(" ".join([t for _, t in lines]).encode("utf-8", "surrogatepass"), np.uint8)


def run_keys(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit hash of the depth tokens from each place on (fewer at the end)."""
    out, n = np.zeros(len(tokens), np.uint64), len(tokens)
    with np.errstate(over="ignore"):
        for i in range(depth):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out[: max(0, n - i)] += tokens[i:]
        return out ^ out >> np.uint64(31)


def sketch(tokens: np.ndarray, depth: int = MIN_WORDS) -> list[int]:
    """The least of several hashes of a text's runs: near copies have most of these in common."""
    n = len(tokens)
    keys = run_keys(tokens, min(depth, n))[: max(1, n - depth + 1)] if n else np.zeros(1, np.uint64)
    out, mixed = [], keys ^ keys >> np.uint64(29)
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[: len(SKETCH)]:
        with np.errstate(over="ignore"):
            out.append(int((mixed * np.uint64(odd)).min().view(np.int64)))
    return out


def _differ(prefix: str = "", low: str = "lo", high: str = "hi") -> F.Column:
    """Whether all sketches tell several pages apart."""
    return reduce(lambda a, b: a & b, (F.col(f"{prefix}{low}{i}") != F.col(f"{prefix}{high}{i}") for i in range(len(SKETCH))))


def _ends(rows: DataFrame, keys: list[str], low: str, high: str, *others) -> DataFrame:
    return rows.groupBy(*keys).agg(*(f(f"{c}{i}").alias(f"{n}{i}") for i in range(len(SKETCH)) for f, c, n in ((F.min, low, "lo"), (F.max, high, "hi"))), *others)


def _keys(host: str, tokens: np.ndarray, depth: int) -> np.ndarray:
    """KEY_BITS of a hash of the host and the depth words from each place on."""
    n = max(0, len(tokens) - depth + 1)
    with np.errstate(over="ignore"):
        keys = (run_keys(tokens, depth)[:n] ^ np.uint64(xxhash.xxh64_intdigest(host))) * np.uint64(0x9E3779B97F4A7C15)
        return (keys ^ keys >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - KEY_BITS)


def _asks(lines: list[tuple[str, str]]) -> bool:
    """Whether a page's text may turn on repeats of a few pages: it has doubted blocks, or more open words than its article has."""
    open_, told = (sum(t.count(" ") + 1 for sign, t in lines if sign in x) for x in ((UNDECIDED,), (TEXT, UNSURE)))
    return open_ > told or any(sign == UNSURE for sign, _ in lines)


def _flag(host: str) -> np.ndarray:
    """The key of a host with a page that asks."""
    return np.array([xxhash.xxh64_intdigest(f"asks\n{host}") >> 64 - KEY_BITS], np.uint64)


def _bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bucket = keys >> np.uint64(KEY_BITS - SIEVE_BITS)
    return bits[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1 > 0


def sieve(rows: DataFrame, depth: int = MIN_WORDS) -> np.ndarray:
    """For each of 2^SIEVE_BITS ranges of keys, a bit whether a run of depth words in it stands twice on its host (the first
    row), and one whether MIN_PAGES times (the second). The flags of hosts that ask are in the first as well.

    rows: host, html. What a row of the sieve drops occurs too seldom on its host to be a repeat, or boilerplate; what it lets
    through may be. Keys go to the owners of their ranges sorted, as gaps, some two bytes each; bits alone come back.
    """
    ship(rows.sparkSession)
    width = min(shuffle_width(rows.sparkSession), 1 << 12)
    starts = np.arange(width + 1) * (1 << SIEVE_BITS - 3) // width  # bytes of the sieve
    bounds = starts.astype(np.uint64) << np.uint64(KEY_BITS - SIEVE_BITS + 3)

    def packed(held):
        keys = np.sort(np.concatenate(held))
        at = np.searchsorted(keys, bounds).tolist()
        out = []
        for i, (a, b) in enumerate(zip(at, at[1:])):
            if a < b:
                gaps = np.diff(keys[a:b], prepend=bounds[i])
                out.append((i, b - a, pa.compress(gaps.view(np.uint8).reshape(-1, 8)[:, :GAP_BYTES].T.tobytes(), "zstd", asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["slice", "n", "gaps"])

    def sorted_keys(batches):
        held, size, flagged = [], 0, set()
        for batch in batches:
            for host, page in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(page)
                keys = _keys(host, tokens_of(bytes_of(lines))[0], depth)
                if host not in flagged and _asks(lines):
                    flagged = flagged if len(flagged) < 500_000 else set()
                    flagged.add(host)
                    held += [_flag(host)] * 2
                if len(keys):
                    held.append(keys)
                    size += len(keys)
                if size >= CHUNK:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def bits(i, held):
        keys = np.sort(np.concatenate(held))
        out = np.zeros((2, starts[i + 1] - starts[i]), np.uint8)
        for row, often in enumerate((2, MIN_PAGES)):
            found = keys[often - 1 :][keys[often - 1 :] == keys[: max(0, len(keys) - often + 1)]] >> np.uint64(KEY_BITS - SIEVE_BITS)
            np.bitwise_or.at(out[row], (found >> np.uint64(3)).astype(np.int64) - starts[i], np.uint8(1) << (found & np.uint64(7)).astype(np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(out.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["slice", "bits"])

    def repeated(batches):
        held, last = [], None
        for batch in batches:
            for i, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if held and i != last:
                    yield bits(last, held)
                    held = []
                gaps = np.zeros((n, 8), np.uint8)
                gaps[:, :GAP_BYTES] = np.frombuffer(pa.decompress(blob, GAP_BYTES * n, "zstd"), np.uint8).reshape(GAP_BYTES, n).T
                held.append(np.cumsum(gaps.view(np.uint64).ravel()) + bounds[i])
                last = i
        if held:
            yield bits(last, held)

    dealt = rows.select("host", "html").mapInArrow(sorted_keys, "slice int, n long, gaps binary").repartitionById(width, F.col("slice"))
    out = np.zeros((2, 1 << SIEVE_BITS - 3), np.uint8)
    for i, blob in dealt.mapInArrow(repeated, "slice int, bits binary").collect():
        size = int(starts[i + 1] - starts[i])
        out[:, starts[i] : starts[i + 1]] = np.frombuffer(pa.decompress(bytes(blob), 2 * size, "zstd"), np.uint8).reshape(2, size)
    return out


def suffixes(streams: DataFrame, depth: int = MIN_WORDS) -> DataFrame:
    """h, key (depth words' hashes), stream, place, and the streams' other columns (lo0 .. hi2: the sketches' ends of the pages
    with the stream) for each suffix of depth words or more. streams: host, stream (text), others."""
    ship(streams.sparkSession)
    types = {c: t for c, t in streams.dtypes if c not in ("host", "stream")}

    def of(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                memo = memo if len(memo) < 500_000 else {}
                hosts, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                words = [words_of(x) for x in texts]
                sizes = np.array([len(w) for w in words])
                n = np.maximum(0, sizes - depth + 1)
                rows = np.repeat(np.arange(len(words)), n)
                if not len(rows):
                    continue
                place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                short = (_hashes([w for x in words for w in x], memo) >> np.uint64(32)).astype(">u4")
                keys = short[((np.cumsum(sizes) - sizes)[rows] + place)[:, None] + np.arange(depth)]
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * (4 * depth)
                key = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])
                h, stream = (np.array([xxhash.xxh64_intdigest(x) for x in y], np.uint64).view(np.int64) for y in (hosts, [f"{h}\n{t}" for h, t in zip(hosts, texts)]))
                more = [c.take(pa.array(rows)) for c in part.columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(h[rows]), key, pa.array(stream[rows]), pa.array(place), *more], names=["h", "key", "stream", "place", *types])

    return streams.select("host", "stream", *types).mapInArrow(of, "h long, key binary, stream long, place long, " + ", ".join(f"{c} {t}" for c, t in types.items()))


def suffix_array(streams: DataFrame, depth: int = MIN_WORDS) -> DataFrame:
    """The suffixes in order, staged: those of suffixes, and part (the task) and run (the interval of neighbours with a common
    prefix of depth words within it)."""
    order = ("h", "key", "stream", "place")

    def of(batches):
        part, run, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            if not len(batch):
                continue
            h = batch.column(0).to_numpy()
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, depth)
            prefix = np.zeros(len(batch), np.int64)  # words in common with the suffix before
            prefix[1:] = np.where(h[1:] == h[:-1], np.cumprod(words[1:] == words[:-1], axis=1).sum(1), 0)
            if last and last[0] == h[0]:
                prefix[0] = np.cumprod(words[0] == last[1]).sum()
            last = h[-1], words[-1].copy()
            runs = run + np.cumsum(prefix < depth)
            run = int(runs[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part)), pa.array(runs)], names=[*batch.schema.names, "part", "run"])

    rows = suffixes(streams, depth)
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(of, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", part long, run long"), "suffixes", compression="zstd")


def repeats(array: DataFrame) -> DataFrame:
    """part, run, whole of each interval with suffixes of several distinct pages; whole names the interval over the borders."""
    intervals = staged(_ends(array, ["part", "run"], "lo", "hi", F.xxhash64(F.first("h"), F.first("key")).alias("whole")), "intervals")
    edges = intervals.groupBy("part").agg(F.max("run").alias("last"))  # a row a task
    at_edge = intervals.join(F.broadcast(edges), "part").where("run = 0 or run = last").drop("last")
    joined = _ends(at_edge, ["whole"], "lo", "hi", F.collect_list(F.struct("part", "run")).alias("pieces")).where(_differ())
    over = joined.select(F.explode("pieces").alias("p"), "whole").select("p.part", "p.run", "whole")
    inside = intervals.where(_differ()).select("part", "run", "whole")
    return inside.union(over).distinct()


def covered_places(array: DataFrame) -> DataFrame:
    """stream, place, whole (the repeat) of each suffix that begins a repeat."""
    return array.select("part", "run", "stream", "place").join(repeats(array), ["part", "run"]).select("stream", "place", "whole")


def _told_apart(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    each = rows.select(*by, F.posexplode(F.array(*SKETCH)).alias("i", "mark")).distinct().groupBy(*by, "i").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.min("n").alias(name))


def _enough() -> F.Column:
    return F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("pages") * SHARE))


def common_repeats(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """set of each set of repeats that stands on enough distinct pages of its host. found: host, set and SKETCH of each page
    that it stands on; hosts: host, pages (distinct ones)."""
    return _told_apart(found.distinct(), ["host", "set"], "n").join(hosts, "host").where(F.col("n") >= _enough()).select("set")


def _cover(places: list[int], n: int, depth: int) -> np.ndarray:
    out = np.zeros(n + 1, np.int64)
    if len(places):
        at = np.asarray(places)
        np.add.at(out, at, 1)
        np.add.at(out, np.minimum(at + depth, n), -1)
    return np.cumsum(out)[:n] > 0


def kept_words(signs: str, sizes: list[int], repeated: list[int] | None, common: list[int] | None, depth: int = MIN_WORDS) -> np.ndarray:
    """Which words of a page are its text, from its blocks' signs and sizes and the places where repeats and common repeats begin."""
    ends = np.cumsum(sizes, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    shared, everywhere, keep = _cover(repeated or [], n, depth), _cover(common or [], n, depth), np.zeros(n, bool)
    at = [slice(int(e) - s, int(e)) for s, e in zip(sizes, ends)]
    told, open_ = [i for i, x in enumerate(signs) if x in (TEXT, UNSURE)], [i for i, x in enumerate(signs) if x == UNDECIDED]
    own = {i: sizes[i] - int(shared[at[i]].sum()) for i in open_}
    if told:
        size = sum(sizes[i] for i in told)
        # an article that is boilerplate of the host beside more words of the page's own isn't the text
        rest = sum(sizes[i] - int(everywhere[at[i]].sum()) for i in open_)
        if not (4 * sum(int(everywhere[at[i]].sum()) for i in told) > 3 * size and rest > size):
            for i in told:
                keep[at[i]] = signs[i] == TEXT or 4 * int(shared[at[i]].sum()) <= 3 * sizes[i]
            return keep
    whole = keep.copy()
    for i in open_:
        whole[at[i]] = True
    if not open_ or not everywhere.any():
        return whole
    covered = {i: 4 * int(everywhere[at[i]].sum()) > 3 * sizes[i] for i in open_}
    total, longest = sum(sizes[i] for i in open_), max(open_, key=lambda i: sizes[i])
    # the stretch with most words of the page's own, a repeated one counting half against it; the longest block if all are repeated
    best, start, score = (longest, longest, 0.0), open_[0], 0.0
    for i in open_:
        if score <= 0:
            start, score = i, 0.0
        score += own[i] - (sizes[i] - own[i]) / 2
        if score > best[2]:
            best = (start, i, score)
    first, last = min(best[0], longest), max(best[1], longest)
    for i in open_:
        if covered[i] and not first <= i <= last:
            continue
        cut = everywhere[at[i]].copy()
        if i == longest or (cut.all() and 2 * sizes[i] > total):
            cut[:] = False
        elif not cut.all():  # where a run covers fewer than depth words of a block, it ends in its neighbour: these stay
            edges = np.flatnonzero(np.diff(np.r_[False, cut, False]))
            for a, b in zip(edges[::2], edges[1::2]):
                cut[a:b] = b - a >= depth and 2 * (b - a) <= total
        keep[at[i]] = ~cut
    return keep if keep.any() else whole


def decide(stream: str, repeated: list[int] | None, common: list[int] | None, depth: int = MIN_WORDS) -> str:
    """The text of a page, from its stream and the places where repeats and common repeats begin."""
    lines = [x for x in stream.split("\n") if x]
    signs = "".join(x[0] for x in lines)
    if not repeated and not common:  # the array says nothing
        wanted = (TEXT, UNSURE) if TEXT in signs or UNSURE in signs else (UNDECIDED,)
        return " ".join(x[1:] for x in lines if x[0] in wanted)
    words = [x[1:].split() for x in lines]
    sizes = [len(w) for w in words]
    keep, at, out = kept_words(signs, sizes, repeated, common, depth), 0, []
    for line, size in zip(lines, sizes):
        part = keep[at : at + size]
        at += size
        if part.any():
            out.append(line[1:] if part.all() else " ".join(w for w, x in zip(line[1:].split(), part) if x))
    return " ".join(out)


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, html, host, number (of host and html) of each page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    return rows.withColumn("number", F.xxhash64("host", "html"))


def _parsed(rows: DataFrame, depth: int, rare: bool = False) -> DataFrame:
    """number, host, SKETCH, signs and sizes (of its blocks), runs (start, stream, text) of each page, staged.

    Runs are the words that pass the sieve: on hosts of pages that ask (on all, if rare) whatever may stand twice, on others
    whatever may be boilerplate. They are cut where their words say so, so that equal passages have equal pieces; each run of
    depth words is in one piece.
    """
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(sieve(rows, depth))

    def of(batches):
        asks: dict[str, bool] = {}
        run = pa.struct([("start", pa.int32()), ("stream", pa.int64()), ("text", pa.string())])
        for batch in batches:
            out = []
            for number, host, page in zip(*(c.to_pylist() for c in batch.columns)):
                asks = asks if len(asks) < 500_000 else {}
                lines = lines_of(page)
                signs, sizes = "".join([sign for sign, _ in lines]), [t.count(" ") + 1 for _, t in lines]
                data = bytes_of(lines)
                tokens, starts = tokens_of(data)
                # pages are told apart by their article or, where that is longer, their longest open block
                told = np.repeat(np.array([x == TEXT for x in signs], bool), sizes)
                size = int(told.sum())
                longest = max((i for i, x in enumerate(signs) if x == UNDECIDED), key=lambda i: sizes[i], default=None)
                if longest is not None and sizes[longest] > size:
                    at = sum(sizes[:longest])
                    told = slice(at, at + sizes[longest])
                marks = [x >> 32 for x in sketch(tokens[told], depth)]
                keys = _keys(host, tokens, depth)
                if host not in asks:
                    asks[host] = rare or bool(_bit(bits.value[0], _flag(host))[0])
                passed = _bit(bits.value[0 if asks[host] else 1], keys)
                ends = keys & np.uint64(7) == 0
                before, after = np.r_[False, (passed & ~ends)[:-1]], np.r_[passed[1:], False] & ~ends
                runs = []
                for a, b in zip(np.flatnonzero(passed & ~before).tolist(), np.flatnonzero(passed & ~after).tolist()):
                    text = UNDECIDED + data[starts[a] : starts[b + depth] - 1].tobytes().decode("utf-8", "surrogatepass")
                    runs.append({"start": a, "stream": int(np.uint64(xxhash.xxh64_intdigest(f"{host}\n{text}")).view(np.int64)), "text": text})
                out.append((number, host, *marks, signs, sizes, runs))
            if out:
                types = (pa.int64(), pa.string(), *[pa.int32()] * len(SKETCH), pa.string(), pa.list_(pa.int32()), pa.list_(run))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["number", "host", *SKETCH, "signs", "sizes", "runs"])

    schema = f"number long, host string, {', '.join(f'{x} int' for x in SKETCH)}, signs string, sizes array<int>, runs array<struct<start: int, stream: long, text: string>>"
    return staged(rows.select("number", "host", "html").mapInArrow(of, schema), "pages", compression="zstd")


def _runs(parts: DataFrame) -> DataFrame:
    """host, number, SKETCH, start, stream, text of each run of each page."""
    return parts.select("host", "number", *SKETCH, F.explode("runs").alias("r")).select("host", "number", *SKETCH, "r.start", "r.stream", "r.text")


def _array_of(parts: DataFrame, depth: int) -> DataFrame:
    """The suffix array of all hosts' runs, a run once however many pages have it."""
    marked = _runs(parts).select("host", F.col("text").alias("stream"), *(F.col(x).alias(f"m{i}") for i, x in enumerate(SKETCH)))
    return suffix_array(_ends(marked, ["host", "stream"], "m", "m"), depth)


def _evidence(parts: DataFrame, depth: int) -> DataFrame:
    """number, signs, sizes, repeated, common (the places where the array's repeats begin) of each page with a repeat."""
    covered = staged(covered_places(_array_of(parts, depth)), "covered")
    held = staged(_runs(parts).groupBy("stream").agg(F.first("host").alias("host"), F.count(F.lit(1)).alias("n")), "runs")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A repeat that stands on enough distinct pages stands on so many at all, which is cheaper to count.
    counts = covered.join(held, "stream").groupBy("whole").agg(F.first("host").alias("host"), F.sum("n").alias("n"))
    hosts = staged(_told_apart(parts, ["host"], "pages"), "hosts")
    few = counts.where(F.col("n") >= MIN_PAGES).join(hosts, "host").where(F.col("n") >= _enough()).select("whole")
    # Repeats that the same runs hold stand on the same pages: these are counted once for all of them.
    asked = staged(covered.join(few, "whole").select("whole", "stream").distinct(), "frequent")
    sets = staged(asked.groupBy("whole").agg(F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("stream")), F.min("stream")).alias("set")), "sets")
    by_run = asked.join(sets, "whole").groupBy("stream").agg(F.collect_set("set").alias("sets")).join(held.select("stream", "n"), "stream")
    on = hot_join(_runs(parts).select("host", "stream", *SKETCH), staged(by_run, "asked"), "stream", "n", total)
    often = common_repeats(on.select("host", F.explode("sets").alias("set"), *SKETCH), hosts)
    common = staged(sets.join(often, "set").select("whole"), "common").withColumn("common", F.lit(True))
    places = covered.join(common, "whole", "left").groupBy("stream").agg(F.collect_set("place").alias("all"), F.collect_set(F.when(F.col("common"), F.col("place"))).alias("often"))
    each = hot_join(_runs(parts).select("number", "stream", "start"), staged(places.join(held.select("stream", "n"), "stream"), "places"), "stream", "n", total)
    shifted = lambda c: F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("start"))))
    found = each.groupBy("number").agg(shifted("all").alias("repeated"), shifted("often").alias("common"))
    return parts.select("number", "signs", "sizes").dropDuplicates(["number"]).join(found, "number")


def repeated_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = MIN_WORDS) -> DataFrame:
    """id, sign (0 furniture by tags, 1 open, 2 doubted within an article, A an article's other blocks), blocks, repeated of
    each page: how many of its blocks the array finds to repeat on its host, in three quarters of their words or more."""
    rows = _rows(pages, id_col, url_col, html_col)
    parts = _parsed(rows, depth, rare=True)
    places = _evidence(parts, depth).select("number", "repeated")

    def of(batches):
        for batch in batches:
            rows = []
            for i, signs, sizes, places in zip(*(c.to_pylist() for c in batch.columns)):
                shared, at, counts = _cover(places or [], sum(sizes), depth), 0, {}
                for sign, n in zip(signs, sizes):
                    found = counts.setdefault(sign, [0, 0])
                    found[0] += 1
                    found[1] += 4 * int(shared[at : at + n].sum()) > 3 * n
                    at += n
                rows += [(i, sign, *c) for sign, c in counts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64()))], names=["id", "sign", "blocks", "repeated"])

    shapes = parts.select("number", "signs", "sizes").dropDuplicates(["number"]).join(places, "number", "left")
    return rows.select("id", "number").join(shapes, "number").select("id", "signs", "sizes", "repeated").mapInArrow(of, f"id {dict(rows.dtypes)['id']}, sign string, blocks long, repeated long")


def _overruled(evidence: DataFrame, depth: int) -> DataFrame:
    """number, repeated, common of the pages whose text the array makes another than tags alone would."""

    def of(batches):
        for batch in batches:
            signs, sizes, repeated, common = (c.to_pylist() for c in batch.columns[1:])
            differ = [not np.array_equal(kept_words(*x, depth), kept_words(*x[:2], None, None, depth)) for x in zip(signs, sizes, repeated, common)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4)], names=["number", "repeated", "common"]).filter(pa.array(differ, pa.bool_()))

    found = evidence.select("number", "signs", "sizes", F.col("repeated").cast("array<long>"), F.col("common").cast("array<long>"))
    return staged(found.mapInArrow(of, "number long, repeated array<long>, common array<long>"), "overruled")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = MIN_WORDS) -> DataFrame:
    """id, url, text of each page."""
    rows = _rows(pages, id_col, url_col, html_col)
    overruled = _overruled(_evidence(_parsed(rows, depth), depth), depth)

    def of(batches):
        for batch in batches:
            text = [decide(stream_of(page), r, c, depth) for page, r, c in zip(*(batch.column(x).to_pylist() for x in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["id", "url", "text"])

    found = rows.join(overruled, "number", "left").select("id", "url", "html", "repeated", "common")
    return found.mapInArrow(of, f"id {dict(rows.dtypes)['id']}, url string, text string")


def op1_host_suffix(spark, sf_dir):
    found = main_texts(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
