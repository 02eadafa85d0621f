"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is a run of frames with a seek table (a skippable frame with every frame's
compressed and plain size) as its footer, so any tool for the seekable format can open its bytes. The archive is a table of
bundles: `bundle`, `content` (the bytes of one .warc.zst file) and `entries`, which maps record identifiers to a frame and the
offset in it. Reading entries leaves the contents on disk; reading one record decompresses one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlay_jobs.session import BROADCAST_ROWS, HOT_LEAST, HOT_SHARE, broadcast_if_small, settle

#: Plain bytes of a frame and of a bundle, about; a larger record has a frame to itself.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

ARCHIVE = "bundle string, content binary, entries array<struct<record_id: string, frame: int, offset: int, length: int>>"
RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def _urn(page_id: int | None, digest: str) -> str:
    """A record's identifier names its page and its payload's digest, so that revisits can name it: only rows that repeat each
    other have the same."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}>"


def _page(urn: str) -> int | None:
    name = urn[len("<urn:x-page:") : -1].split(":")[0]
    return None if name == "null" else int(name)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {_urn(page_id, digest)}\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    if revisit:
        head += f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: {_urn(refers_to, digest)}\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return b"".join([head.encode(), block, b"\r\n\r\n"])


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    return head, data[stop + 4 : end], end + 4


def seal(frames: list[bytes], sizes: list[int]) -> bytes:
    """The bytes of a bundle: frames, then their seek table."""
    table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(frames, sizes)) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join([*frames, struct.pack("<II", SKIPPABLE, len(table)), table])


def seek_table(content: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each frame in a bundle."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    rows = content[len(content) - 9 - n * width : len(content) - 9]
    out, at = [], 0
    for i in range(n):
        length = struct.unpack_from("<I", rows, i * width)[0]
        out.append((at, length))
        at += length
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(level=3, write_checksum=True)
    frames: list[bytes] = []
    sizes: list[int] = []
    entries: list[dict] = []
    frame: list[bytes] = []
    filled = 0

    def close_frame() -> None:
        nonlocal frame, filled
        if frame:
            frames.append(press.compress(b"".join(frame)))
            sizes.append(filled)
            frame, filled = [], 0

    def bundle() -> pa.RecordBatch:
        nonlocal frames, sizes, entries, n
        row = {"bundle": [f"{task:06d}-{n:06d}"], "content": [seal(frames, sizes)], "entries": [entries]}
        frames, sizes, entries, n = [], [], [], n + 1
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("entries", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))]))

    for batch in batches:
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for page, url, payload, sha1, refers, revisit in zip(*(c.to_pylist() for c in cols)):
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            record = make_record(page, url, payload, digest, refers, revisit)
            if filled and filled + len(record) > FRAME_BYTES:
                close_frame()
                if sum(sizes) >= BUNDLE_BYTES:
                    yield bundle()
            entries.append({"record_id": _urn(page, digest), "frame": len(frames), "offset": filled, "length": len(record)})
            frame.append(record)
            filled += len(record)
    close_frame()
    if frames:
        yield bundle()


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write one record per row into bundles at `path`.

    Of the records with equal payloads (SHA-1 and length) of at least min_bytes, those with the largest id are responses and the
    others revisit it; a null id counts as smaller than any, and where all are null all are responses; rows that repeat the
    largest id are all responses. A null payload is empty; rows that repeat each other in id and payload have one identifier; an
    empty table gives an archive without bundles; other columns are not read. A very long payload has a frame to itself, of up to
    2 GiB. Bundles are filled within a task: payloads move only if the table of repeated digests is too large to broadcast, and
    then those of digests that stand very often still stay where they are.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = own.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    repeats = own.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.count("*").alias("rows"), F.max("page").alias("first")).where("rows > 1 AND first IS NOT NULL")
    repeats = settle(repeats.select(F.col("sha1").alias("s"), F.col("n").alias("m"), "first", "rows"), "warc-repeats")
    same = (F.col("sha1") == F.col("s")) & (F.col("n") == F.col("m"))
    digests, total = repeats.agg(F.count("*"), F.sum("rows")).head()
    if digests <= BROADCAST_ROWS:
        joined = own.join(F.broadcast(repeats), same, "left")
    else:
        often = F.col("rows") > max(HOT_LEAST, total // HOT_SHARE)  # HOT_SHARE digests at most
        hot = F.broadcast(repeats.where(often))
        joined = own.join(hot, same, "left_anti").join(repeats.where(~often), same, "left").unionByName(own.join(hot, same))
    revisit = F.col("first").isNotNull() & (F.col("page").isNull() | (F.col("page") < F.col("first")))
    rows = joined.select("page", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers"), revisit.alias("revisit"))
    rows.mapInArrow(_pack, ARCHIVE).write.parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records of bundles (content, entries): each frame is opened once, its records are cut out by the record map."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        for content, entries in zip(batch.column("content"), batch.column("entries")):
            content, frames = content.as_py(), {}
            for entry in entries.as_py():
                frames.setdefault(entry["frame"], []).append(entry)
            table = seek_table(content)
            for frame, own in frames.items():
                at, length = table[frame]
                data, rows = open_.decompress(content[at : at + length]), []
                for entry in own:
                    head, block, _ = parse_record(data[entry["offset"] : entry["offset"] + entry["length"]])
                    if head["WARC-Record-ID"] != entry["record_id"]:
                        raise ValueError(f"{entry['record_id']}: the record map leads to {head['WARC-Record-ID']}")
                    rows.append(_read(head, block, payloads))
                names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)


def _read(head: dict, block: bytes, payloads: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(line[16:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
    refers = head.get("WARC-Refers-To")
    return _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], digest, n, _page(refers) if refers else None, payload if payloads else None


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of an archive, payloads checked against their digests: page_id, url, record_type, payload_digest,
    payload_bytes (of the full payload, for revisits too), refers_to, payload (empty for revisits; null if not asked for)."""
    return spark.read.schema(ARCHIVE).parquet(path).select("content", "entries").mapInArrow(lambda batches: _unpack(batches, payloads), RECORDS)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, bundle, frame, offset, length of every record; reads no contents."""
    rows = spark.read.schema(ARCHIVE).parquet(path).select("bundle", F.explode("entries").alias("e"))
    page = F.split_part("e.record_id", F.lit(":"), F.lit(3)).try_cast("bigint")  # null for a null id
    return rows.select("e.record_id", page.alias("page_id"), "bundle", "e.frame", "e.offset", "e.length")


def fetch(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Records of some pages, as of read_archive(). ids: a table of page ids.

    Places are gathered per bundle first, so a bundle's bytes travel once however many of its records are asked for, and each asked
    frame is decompressed once, the others not at all. An id that is asked more than once gives its records once; one that stands
    on several records gives all of them, equal rows as often as they were written; a null id gives the records without an id;
    unknown ids give no row; other columns of `ids` are not read.
    """
    wanted = broadcast_if_small(settle(ids.select(F.col(id_col).cast("long").alias("asked")).distinct(), "warc-asked"))
    places = record_index(spark, path).join(wanted, F.col("page_id").eqNullSafe(F.col("asked")), "left_semi")
    places = places.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("asked_for"))
    places = settle(places, "warc-places")
    if (places.agg(F.sum(F.size("asked_for"))).head()[0] or 0) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    contents = spark.read.schema(ARCHIVE).parquet(path).select(F.col("bundle").alias("own"), "content")
    return contents.join(places, F.col("own") == F.col("bundle")).select("content", F.col("asked_for").alias("entries")).mapInArrow(lambda batches: _unpack(batches, True), RECORDS)
