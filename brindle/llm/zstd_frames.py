"""Files of independent Zstandard frames with a trailing seek table.

The table is itself a skippable frame in the public seekable layout, so any Zstandard tool can decompress a whole
file: for each frame its compressed size, its size and a 32-bit checksum of its content, then the number of frames,
a descriptor byte and the magic number.

Defined results: units of no bytes are units all the same, with a place of their own; a unit longer than a frame has a
frame to itself; equal units are written each; a file without units holds an empty seek table; a frame whose content
doesn't match its checksum is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import xxhash
import zstandard

# Fixed values of the seekable format: magic numbers, and the descriptor's bit for checksums.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


def checksum(data: bytes) -> int:
    """The least 32 bits of a frame's XXH64, as the seekable format has it."""
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Collects bytes into frames of about frame_bytes; a caller's unit is never split over two frames."""

    def __init__(self, stream, frame_bytes: int, level: int = 3):
        self.stream, self.frame_bytes, self.table = stream, frame_bytes, []
        self.pack, self.parts, self.size = zstandard.ZstdCompressor(level=level), [], 0

    def put(self, unit: bytes) -> tuple[int, int]:
        """(frame number, offset within the frame's content) of a unit."""
        if self.size and self.size + len(unit) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.size
        self.parts.append(unit)
        self.size += len(unit)
        return place

    def flush(self) -> None:
        if self.parts:
            content = b"".join(self.parts)
            frame = self.pack.compress(content)
            self.stream.write(frame)
            self.table.append((len(frame), len(content), checksum(content)))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.stream.close()


class FrameReader:
    """Reads the seek table from the end of a file, then any frame on request."""

    def __init__(self, stream):
        self.stream, end = stream, stream.size()
        count, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not descriptor & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of this file")
        self.table = list(struct.iter_unpack("<III", self._at(end - 9 - 12 * count, 12 * count)))
        self.starts = [0]
        for packed, _, _ in self.table:
            self.starts.append(self.starts[-1] + packed)
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        content = self.unpack.decompress(self._at(self.starts[k], packed), max_output_size=max(1, size))
        if len(content) != size or checksum(content) != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return content

    def frames(self) -> Iterator[bytes]:
        return map(self.frame, range(len(self.table)))
