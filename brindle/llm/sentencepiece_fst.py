"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiling a model gives three machines: a normaliser (adds the dummy prefix, maps each space to U+2581), a lexicon (a
trie over characters whose final states emit a piece with its weight) and a byte fallback (a character that is no
piece is emitted as the pieces of its UTF-8 bytes). Composed with an input they span a lattice of positions and
pieces, and the encoding is its shortest path in the tropical semiring: weights add along a path, the least sum wins.

The weight of a piece is its negative score in unigram models. The scores of BPE models are merge ranks and don't
add up to the right path, so for these the lattice is composed with a third acceptor: a sequence of pieces is the
BPE encoding of its text exactly if each two neighbours are the encoding of their own concatenation. It admits
two pieces in a row on that condition alone (remembered for each pair), and then just one path is left at every
position. Ranks of several pieces may be equal where they are runs of U+2581 (the normaliser's image of spaces); then no
condition on neighbours decides, so a run of n such characters has arcs of its own: the pieces of n, or of n - 1 where
the next piece begins with the last of them.

A state's shortest path depends on what lies before it alone, so a batch's new segments are composed in order, and those
that begin alike share the states of what they have in common.

No piece but runs of U+2581 has that character anywhere but at its start, so an input falls apart into segments in
front of each such run; segments are composed one at a time and remembered. A model with pieces that cross such a
place takes its texts as one segment.

Defined results: a null or empty text has no pieces and decodes to an empty text. U+2581 in a text reads as a space
does. Repeated rows are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import load, parts_of

SPACE = "▁"
#: Bytes of segments and their ids (with what Python adds to each), and pairs of pieces, that a worker remembers; beyond that it starts anew.
MEMO_BYTES, OVERHEAD = 48 << 20, 200
PAIRS = 300_000
#: Bytes of text that are encoded at a time: as segments they take dozens of times as much.
PART_BYTES = 1 << 19
INFINITE = float("inf")
#: What a lattice's state has in place of the id of the last piece.
START, FALLBACK, NOWHERE = -2, -1, -3
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class PieceTransducer:
    """The compiled machines of one model."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as stream:
            model.ParseFromString(stream.read())
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only unigram and BPE models with the identity normaliser can be compiled")
        self.bpe = model.trainer_spec.model_type == BPE
        self.prefix, self.squeeze = model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.lexicon = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.weight = {i: -model.pieces[i].score for i in self.lexicon.values()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        self.fallback = 10.0 - min(-w for w in self.weight.values()) if not self.bpe else 0.0
        self.split = not any(SPACE in p.lstrip(SPACE) for p in self.lexicon)
        self.arcs: list[dict[str, int]] = [{}]  # the lexicon read backwards, so that a lattice grows by its last piece
        self.emits: list[int] = [-1]
        for piece, i in self.lexicon.items():
            state = 0
            for c in reversed(piece):
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.emits.append(-1)
                state = self.arcs[state][c]
            self.emits[state] = i
        self.level_runs = len({self.weight[i] for p, i in self.lexicon.items() if len(p) > 1 and not p.strip(SPACE)}) < 2
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0
        self.pairs: dict[int, bool] = {}
        self.out = [self._surface(i) for i in range(len(self.pieces))]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ").strip(" "))
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """The BPE encoding of a text by its definition: merge the best pair, the leftmost of equals."""
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        lexicon, weight = self.lexicon, self.weight
        heap = [(weight[i], at, x + y) for at, (x, y) in enumerate(zip(parts, parts[1:])) if (i := lexicon.get(x + y)) is not None]
        heapify(heap)
        while heap:
            _, at, both = heappop(heap)
            right = after[at]
            if not parts[at] or right >= n or parts[at] + parts[right] != both:
                continue  # one of the two has been merged since
            parts[at], parts[right], after[at] = both, "", after[right]
            if after[at] < n:
                before[after[at]] = at
                if (i := lexicon.get(both + parts[after[at]])) is not None:
                    heappush(heap, (weight[i], at, both + parts[after[at]]))
            if before[at] >= 0 and (i := lexicon.get(parts[before[at]] + both)) is not None:
                heappush(heap, (weight[i], before[at], parts[before[at]] + both))
        return [p for p in parts if p]

    def run(self, n: int) -> list[int]:
        """The pieces of n spaces in a row: the arc that the normaliser's runs have in the lattice."""
        if not self.level_runs:
            return [self.lexicon[x] for x in self.merged(SPACE * n)]
        out: list[int] = []  # all longer pieces weigh the same, so the leftmost pair that has a piece is always next
        known = [self.lexicon.get(SPACE * k) for k in range(max((len(p) for p in self.lexicon if not p.strip(SPACE)), default=1) + 1)]
        fits = lambda k: k < len(known) and known[k] is not None
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and fits(out[-2] + out[-1]):
                last = out.pop()
                out[-1] += last
        return [known[k] for k in out]

    def admits(self, x: int, y: int) -> bool:
        """Whether piece y may follow piece x."""
        key = x * len(self.pieces) + y
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.pieces[x], self.pieces[y]
            found = self.pairs[key] = self.merged(x + y) == [x, y]
        return found

    def learn(self, segments: list[str]) -> None:
        """Composes segments with the machines and remembers their shortest paths.

        In order, so that segments that begin alike share the lattice of what they have in common.
        """
        weights, begins, last, before = [0.0], [0], [START], ""
        runs: list[list[int]] = []
        for text in sorted(segments):
            if self.bpe and text.startswith(SPACE + SPACE):
                n = len(text) - len(text.lstrip(SPACE))
                runs = [self.run(n), self.run(n - 1)]
                tail = text[n - 1 :]
                # two arcs for the run: with its last space, or without it where the word after it begins with one
                lattice = [0.0, 0.0], [0, 0], [runs[1][-1], runs[0][-1]]
                self.extend(tail, 2, *lattice)
                path, end = self.path(tail, 2, *lattice)
                ids, before = runs[1 - end] + path, ""
                weights, begins, last = [0.0], [0], [START]
            else:
                shared = 0
                for a, b in zip(before, text):
                    if a != b:
                        break
                    shared += 1
                del weights[shared + 1 :], begins[shared + 1 :], last[shared + 1 :]
                self.extend(text, shared + 1, weights, begins, last)
                ids, before = self.path(text, 1, weights, begins, last)[0], text
            found = array("I", ids).tobytes()
            self.memo[text] = found
            self.memo_bytes += len(found) + 4 * len(text) + OVERHEAD

    def extend(self, text: str, first: int, weights: list[float], begins: list[int], last: list[int]) -> None:
        """Adds the states from first on: for each, the least weight that reaches it and the last arc on that path."""
        arcs, emits, weight, lexicon, admits, bpe, pairs, many = self.arcs, self.emits, self.weight, self.lexicon, self.admits, self.bpe, self.pairs, len(self.pieces)
        for end in range(first, len(text) + 1):
            total, begin, piece = INFINITE, 0, NOWHERE
            state, at = 0, end
            while at:
                state = arcs[state].get(text[at - 1])
                if state is None:
                    break
                at -= 1
                i = emits[state]
                if i >= 0 and (x := last[at]) != NOWHERE and (w := weights[at] + weight[i]) <= total:
                    if bpe and x >= 0 and not (known if (known := pairs.get(x * many + i)) is not None else admits(x, i)):
                        continue
                    total, begin, piece = w, at, i
                    if bpe:
                        break  # the acceptor leaves one path
            if text[end - 1] not in lexicon and last[end - 1] != NOWHERE and weights[end - 1] + self.fallback < total:
                total, begin, piece = weights[end - 1] + self.fallback, end - 1, FALLBACK
            weights.append(total)
            begins.append(begin)
            last.append(piece)

    def path(self, text: str, first: int, weights: list[float], begins: list[int], last: list[int]) -> tuple[list[int], int]:
        """The ids on the best path back from the last state, and the state before first where it began."""
        path, end = [], len(text)
        while end >= first:
            i = last[end]
            if i >= 0:
                path.append(i)
            elif i == FALLBACK:
                path += reversed(self.spelt(text[begins[end] : end]))
            else:
                raise ValueError("no path through the lattice")
            end = begins[end]
        return path[::-1], end

    def spelt(self, character: str) -> list[int]:
        """The byte fallback of a character, or the unknown piece where a model has no byte pieces."""
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]

    def segments(self, text: str) -> list[str]:
        """What a text falls apart into."""
        text = self.normalise(text)
        if not text:
            return []
        if not self.split:
            return [text]
        if SPACE + SPACE in text or text[0] != SPACE:
            return re.findall(f"^[^{SPACE}]+|{SPACE}+[^{SPACE}]*", text)
        return [SPACE + x for x in text[1:].split(SPACE)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed native unsigned 32-bit integers."""
        parts = list(map(self.segments, texts))
        if self.memo_bytes > MEMO_BYTES:
            self.memo, self.memo_bytes = {}, 0
        self.learn(list(set().union(*parts).difference(self.memo)))
        known = self.memo.__getitem__
        return [b"".join(map(known, x)) for x in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if self.types[i] == CONTROL else " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.out.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(1)
def machine_of(model_file: str) -> PieceTransducer:
    """One machine a Python worker, which Spark uses for many tasks in turn."""
    return PieceTransducer(model_file)


def sentencepiece(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (packed little-endian unsigned 32-bit integers), decoded (the text that they give) of each row."""

    ship(docs.sparkSession)

    def of(batches):
        machine = machine_of(model_file)
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                ids = machine.encode_all([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(map(machine.decode, ids), pa.string())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"id {dict(rows.dtypes)['id']}, ids binary, decoded string")


def op9_sentencepiece(spark, sf_dir):
    """doc_id, n_pieces, ids_crc32, decoded_chars, decoded_crc32 of every whole document."""
    import public_tokenizers

    found = sentencepiece(load(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )
