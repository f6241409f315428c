"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent frames that hold whole WARC/1.1 records, with a seek table at its end; the index maps
a record's id to its file, frame and the offset within that frame's content, so that one record is read by
decompressing one frame. Of the records with equal payloads, one is a response and the others are revisits that
refer to it. Which one is decided over digests and ids alone: an aggregation over digests, which combines on the map
side, and a list of the rows that are revisits, which is joined back to the pages by id and digest. Spark broadcasts
that list where its table is small and shuffles by both keys where it isn't, so no payload goes by its digest and
payloads below `min_revisit` bytes don't move at all.

Defined results: a null payload is empty; payloads below `min_revisit` bytes are always responses; repeated rows are
repeated records, and all rows of the least id are responses; a row with a null id is written with an empty id and
refers to a response as others do (it is a response if no row has an id); null URLs are empty; empty tables give no
bundle and an empty result. Bundles are named for their attempt, and the index lists those of attempts that succeeded.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import fresh_path, hot_join, load, open_input, open_output, shuffle_width, staged
from .zstd_frames import FrameReader, FrameWriter

FRAME_BYTES = 1 << 18
MIN_REVISIT = 100
#: Bits of the sketch of revisits: 16 MB where it is broadcast.
SKETCH_BITS = 27
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry no time of their own in the tables, so that reruns write the same bytes.
EPOCH = b"1970-01-01T00:00:00Z"
_ID = b"urn:brindle:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header alone, and says how long the payload was."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    named = lambda i: b"<%s%s>" % (_ID, b"" if i is None else b"%d" % i)
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + named(page_id), b"WARC-Date: " + EPOCH]
    head.append(b"WARC-Target-URI: " + " ".join((url or "").split()).encode())
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + named(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_in(content: bytes):
    """(header fields, block) of each record in a frame."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].split(b"\r\n")
        if first != VERSION:
            raise ValueError("a record doesn't begin with its version")
        fields = dict(x.split(b": ", 1) for x in lines)
        size = int(fields[b"Content-Length"])
        yield fields, content[end + 4 : end + 4 + size]
        if content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record doesn't end as it should")
        at = end + 8 + size


def _id_of(field: bytes) -> int | None:
    found = field[len(_ID) + 1 : -1]
    return int(found) if found else None


def parsed(fields: dict[bytes, bytes], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's digest is checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't match its digest")
    return _id_of(fields[b"WARC-Record-ID"]), size, digest, kind, _id_of(fields[b"WARC-Refers-To"]) if kind == "revisit" else None


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """id, url, payload, digest, refers_to, revisit of each page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    small, large = rows.where(F.octet_length("payload") < min_revisit), rows.where(F.octet_length("payload") >= min_revisit)
    small, large = (x.withColumn("digest", F.sha2("payload", 256)) for x in (small, large))
    named = large.select("id", "digest")
    repeated = staged(named.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null"), "repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    revisits = hot_join(named, repeated, "digest", "n", total).where(~F.col("id").eqNullSafe(F.col("first_id"))).select(F.col("id").alias("i"), F.col("digest").alias("d"), "first_id").distinct()
    revisits = staged(revisits, "revisits")
    large = marked(large, sketch_of(revisits.select(bit_of(F.col("i"), F.col("d")).alias("bit"))))
    found = large.where("maybe").join(revisits, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    found = found.select("id", "url", "payload", "digest", F.col("first_id").alias("refers_to"), F.col("first_id").isNotNull().alias("revisit"))
    rest = large.where("not maybe").drop("maybe").unionByName(small)
    return found.union(rest.select("id", "url", "payload", "digest", F.lit(None).cast("long"), F.lit(False)))


def bit_of(id: Column, digest: Column) -> Column:
    """The bit of an id and a digest, from 1."""
    return F.xxhash64(id, digest).bitwiseAND((1 << SKETCH_BITS) - 1) + 1


def sketch_of(bits: DataFrame) -> DataFrame:
    """bucket, bitmap: the bits that are set, 2^15 to a row, so at most 2^(SKETCH_BITS - 15) rows of 4 KB."""
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def marked(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """rows (with id and digest) and maybe: whether the bit of the row is set in the sketch."""
    placed = rows.withColumn("bit", bit_of(F.col("id"), F.col("digest"))).withColumn("bucket", F.bitmap_bucket_number("bit"))
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(sketch), "bucket", "left")
    return found.withColumn("maybe", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).select(*rows.columns, "maybe")


def write_bundles(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes classified rows as bundles below folder; the index: file, frame, place, id."""
    ship(rows.sparkSession)

    def of(batches):
        writer, name = None, f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"
        for batch in batches:
            found = []
            for i, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                writer = writer or FrameWriter(open_output(name), frame_bytes)
                found.append((name, *writer.put(record(i, url, payload, digest, refers_to, revisit)), i))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["file", "frame", "place", "id"])
        if writer:
            writer.close()

    return staged(rows.mapInArrow(of, "file string, frame int, place long, id long"), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records in the frames of an index."""
    ship(index.sparkSession)

    def of(batches):
        for batch in batches:
            for name, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_input(name) as stream:
                    reader = FrameReader(stream)
                    for k in frames:
                        rows = [parsed(*x) for x in records_in(reader.frame(k))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    runs = index.select("file", "frame").distinct().groupBy("file", F.expr("frame div 32").alias("run")).agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    spread = runs.select("file", "frames").repartition(shuffle_width(index.sparkSession), "file", "frames")
    return spread.mapInArrow(of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_records(index: DataFrame) -> DataFrame:
    """id, kind, payload of the index rows given: one frame is decompressed for each, at its offset."""
    ship(index.sparkSession)

    def of(batches):
        for batch in batches:
            rows = []
            for name, frame, place in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "place"))):
                with open_input(name) as stream:
                    content = FrameReader(stream).frame(frame)
                fields, block = next(records_in(content[place:]))
                rows.append((_id_of(fields[b"WARC-Record-ID"]), fields[b"WARC-Type"].decode(), block.partition(b"\r\n\r\n")[2]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))], names=["id", "kind", "payload"])

    return index.mapInArrow(of, "id long, kind string, payload binary")


def op2_warc_bundles(spark, sf_dir):
    rows = classified(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_bundles(write_bundles(rows, fresh_path(spark, "warc")))


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
