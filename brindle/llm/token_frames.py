"""Token-id files: independent Zstandard frames, per-frame checksums and a trailing seek table.

A file is a run of frames; each holds whole documents, a document being a header (id, whether the id is null, number
of token ids) and its ids as little-endian unsigned 32-bit integers. Documents stand in ascending doc_id order within
and across files (null ids first). A manifest row a file has its token count, and an index row a document its file,
frame and place in it, so a reader decompresses only the frames of the documents that it wants.

Encoding memoises the library's own results. The byte-level pre-tokeniser always cuts before a space that stands
between two characters that aren't white space, and before a line feed that does, so a text is split there, and each
distinct chunk (with its space or line feed) goes through the library once a worker as long as the bounded memo holds
it. The library's defaults hold: the text of a special token in a document becomes that token's id.

Defined results: a null text counts as empty and has the end id alone; repeated rows are repeated documents; an empty
table gives no file and an empty result; very long texts may exceed the usual size of a frame, which then holds just
that document. A file is named for its attempt, and the manifest lists those of the attempts that succeeded.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Collection
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .common import fresh_path, load, open_input, open_output, parts_of, shuffle_width, staged
from .zstd_frames import FrameReader, FrameWriter

#: id, whether it is null, number of token ids.
HEADER = "<qBI"
HEADER_BYTES = struct.calcsize(HEADER)
FRAME_BYTES = 1 << 18
#: Text that is encoded at a time.
PART_BYTES = 1 << 22
#: Chunks that a worker remembers from task to task; beyond half of that it forgets those not met since the last time.
MEMO = 800_000
#: Chunks that go through the library as one text.
JOINED = 200
_LOOSE = re.compile(r"\s\s|^\s|\s\Z")
_OTHER_SPACE = [x for x in map(chr, range(0x3001)) if x.isspace() and x not in " \n"]
#: Up to three of these after Latin letters are a piece of their own to the pre-tokeniser, so one stem serves many chunks.
_TAIL = ".,;:!?)]}*$#%&\"'-"
_LATIN_END = "\u0250"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER = "[" + "".join(rf"\x{{{ord(x):x}}}" for x in _OTHER_SPACE) + "]"


def chunks_of(text: str) -> list[str]:
    """The parts of a text, without the spaces that they were cut at."""
    if not text:
        return []
    chunks = text.replace("\n", " \n").split(" ")
    loose = "" in chunks or "\n" in chunks or any(x in text for x in _OTHER_SPACE) and _LOOSE.search(text)
    return _CUT.split(text) if loose else chunks


def chunk_lists(texts: list[str] | pa.Array) -> tuple[pa.ListArray, list[int]]:
    """The chunks of each text, and which text each list is of; an empty text has one empty chunk, and so has a null one."""
    column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    if column.nbytes > 1 << 28:
        column = column.cast(pa.large_string())
    cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
    offsets, empty = cut.offsets.to_numpy(), pc.is_in(cut.values, pa.array(["", "\n"], column.type)).to_numpy(zero_copy_only=False)
    odd = np.add.reduceat(empty, offsets[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    odd |= pc.match_substring_regex(column, _OTHER).to_numpy(zero_copy_only=False)
    if not odd.any():
        return cut, list(range(len(texts)))
    apart = np.flatnonzero(odd).tolist()  # white space in them may have to stay together
    lists = [cut.filter(pa.array(~odd)), pa.array([chunks_of(t) or [""] for t in column.take(pa.array(apart)).to_pylist()], cut.type)]
    return pa.concat_arrays(lists), np.flatnonzero(~odd).tolist() + apart


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, which makes an Arrow scalar of each string first."""
    return column.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once."""

    def __init__(self, tokenizer: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and chunks are too small for threads
        from tokenizers import Tokenizer

        self.lib, self.end, self.memo, self.old = Tokenizer.from_file(tokenizer), array("I", [end_id]).tobytes(), {}, {}
        self.tails: dict[str, bytes] = {}
        # A byte-level token has a character for each byte; added tokens stand for themselves.
        sizes, added = self.lib.get_vocab(), {i: len(t.content.encode()) for i, t in self.lib.get_added_tokens_decoder().items()}
        self.sizes = np.zeros(max(sizes.values()) + 1, np.int64)
        for token, i in sizes.items():
            self.sizes[i] = added.get(i, len(token))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        lists, places = chunk_lists(texts)
        # each distinct chunk is looked up once, and its ids are laid out by Arrow wherever it stands
        offsets, chunks = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        distinct, spots = _strings(chunks.dictionary), chunks.indices.to_numpy().copy()
        starts = offsets[:-1]
        firsts = [distinct[i] for i in spots[starts].tolist()]
        later = np.bincount(spots, minlength=len(distinct)) > np.bincount(spots[starts], minlength=len(distinct))
        heads = self._known(list(compress(distinct, later.tolist())), firsts)
        table = list(map(self.memo.get, distinct)) + [heads[x] for x in firsts]  # None where a chunk stands first alone
        spots[starts] = np.arange(len(distinct), len(table))
        laid = pa.array(table, pa.large_binary()).take(pa.array(spots))
        ends, body = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[offsets].tolist(), memoryview(laid.buffers()[2] or b"")
        out: list[bytes] = [b""] * len(texts)
        for place, begin, end in zip(places, ends, ends[1:]):
            out[place] = b"".join((body[begin:end], self.end))
        return out

    def _known(self, chunks: list[str], firsts: list[str]) -> dict[str, bytes]:
        """Has the memo hold the ids of all chunks, which are distinct; returns those of the chunks that texts begin with."""
        if len(self.memo) > MEMO // 2:
            self.memo, self.old = {}, self.memo
        memo, heads = self.memo, {"": b""}
        new = self._missing(chunks)
        stems = {x: stem for x in new if x[-1] in _TAIL and len(x) <= len(stem := x.rstrip(_TAIL)) + 3 and stem.isalpha() and (stem.isascii() or max(stem) < _LATIN_END)}
        learn = [x for x in new if x not in stems]
        learn += self._missing(set(stems.values()).difference(learn))
        alone = [x for x in learn if x[-1].isspace()]
        self._learn_alone(memo, alone, " ")
        self._learn(memo, [x for x in learn if not x[-1].isspace()] if alone else learn)
        tails = {x[len(stem) :] for x, stem in stems.items()}
        self._learn_alone(self.tails, list(tails.difference(self.tails)), "")
        for x, stem in stems.items():
            memo[x] = memo[stem] + self.tails[x[len(stem) :]]
        self._learn_alone(heads, list(set(firsts).difference(heads)), "")
        return heads

    def _missing(self, chunks: Collection[str]) -> list[str]:
        """Those of chunks that the memo lacks, once what its older half holds has been moved to the newer one."""
        new = [x for x, ids in zip(chunks, map(self.memo.get, chunks)) if ids is None]
        found = list(map(self.old.get, new))
        self.memo.update((x, ids) for x, ids in zip(new, found) if ids is not None)
        return [x for x, ids in zip(new, found) if ids is None]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_alone(self, memo: dict[str, bytes], chunks: list[str], before: str) -> None:
        for x, ids in zip(chunks, self._ids([before + x for x in chunks])):
            memo[x] = array("I", ids).tobytes()

    def _learn(self, memo: dict[str, bytes], chunks: list[str]) -> None:
        """Encodes many chunks as few texts, which costs the library far less than a call a chunk, and parts the ids by their bytes."""
        spaced = [x if x[0] == "\n" else " " + x for x in chunks]
        if not spaced:
            return
        ids = np.fromiter(chain.from_iterable(self._ids(["".join(spaced[at : at + JOINED]) for at in range(0, len(spaced), JOINED)])), "<u4")
        ends, token_ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in spaced]), np.cumsum(self.sizes[ids])
        last = np.searchsorted(token_ends, ends)
        if last[-1] != len(ids) - 1 or not np.array_equal(token_ends[last], ends):
            raise ValueError("the tokenizer's ids don't add up to the bytes of the text")
        packed, begin = ids.tobytes(), 0
        for x, end in zip(chunks, (4 * last + 4).tolist()):
            memo[x] = packed[begin:end]
            begin = end


@lru_cache(1)
def encoder_of(tokenizer: str, end_id: int) -> ChunkEncoder:
    """One encoder a Python worker, which Spark uses for many tasks in turn."""
    return ChunkEncoder(tokenizer, end_id)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (packed unsigned 32-bit integers with the end id) of each row."""
    ship(docs.sparkSession)

    def of(batches):
        encoder = encoder_of(tokenizer, end_id)
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                yield pa.record_batch([part.column(0), pa.array(encoder.encode(part.column(1)), pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, ids binary")


def write_frames(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encodes docs and writes them as token files below folder; the index: file, part, frame, place, id, n_tokens, first.

    Texts are dealt out by ranges of ids and sorted before they are encoded: they are smaller than their ids.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ("id", F.xxhash64("text"))  # rows under one id, or none, may fill several files
    ranged = rows.repartitionByRange(files or shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)

    def of(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer, end_id)
        writer, name, first = None, f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.bin.zst", 0
        for batch in (part for b in batches for part in parts_of(b, PART_BYTES)):
            rows = []
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                writer = writer or FrameWriter(open_output(name), frame_bytes)
                frame, place = writer.put(struct.pack(HEADER, i or 0, i is None, len(ids) // 4) + ids)
                rows.append((name, part, frame, place, i, len(ids) // 4, first))
                first += len(ids) // 4
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "part", "frame", "place", "id", "n_tokens", "first"])
        if writer:
            writer.close()

    return staged(ranged.mapInArrow(of, "file string, part int, frame int, place long, id long, n_tokens long, first long"), "token-index")


def documents_in(content: bytes):
    """(id, bytes of the ids) of each document in a frame."""
    at = 0
    while at < len(content):
        i, null, n = struct.unpack_from(HEADER, content, at)
        at += HEADER_BYTES
        yield None if null else i, content[at : at + 4 * n]
        at += 4 * n


def manifest_of(index: DataFrame) -> DataFrame:
    """file, part, start (the ids in all files before it) of each token file."""
    sums = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def read_frames(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    ship(manifest.sparkSession)

    def of(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_input(name) as stream:
                    for content in FrameReader(stream).frames():
                        rows = []
                        for i, ids in documents_in(content):
                            rows.append((i, start, len(ids) // 4, zlib.crc32(ids)))
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("file", "start").repartition(shuffle_width(manifest.sparkSession), "file")
    return spread.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(index: DataFrame) -> DataFrame:
    """id, ids (array) of the index rows given; decompresses the frames that hold them and no others."""
    ship(index.sparkSession)

    def of(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        with open_input(group["file"].iloc[0]) as stream:
            content = FrameReader(stream).frame(int(group["frame"].iloc[0]))
        for place in group["place"]:
            i, null, n = struct.unpack_from(HEADER, content, int(place))
            at = int(place) + HEADER_BYTES
            out.append((None if null else i, list(array("I", content[at : at + 4 * n]))))
        return pd.DataFrame({"id": pd.array([i for i, _ in out], "Int64"), "ids": [x for _, x in out]})

    return index.groupBy("file", "frame").applyInPandas(of, "id long, ids array<long>")


def op7_token_frames(spark, sf_dir):
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    index = write_frames(docs, public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-files"))
    return read_frames(manifest_of(index))
