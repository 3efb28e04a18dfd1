"""WARC archives as seekable Zstandard bundles.

Every task groups its records into independent Zstandard frames, writes them as one
file per bundle with a seek table (a skippable frame) as footer, and emits one index
row per record: bundle, frame, and the record's offset within its frame.  Decoders
that know nothing of the table read the file as ordinary Zstandard; readers that do
fetch one record by decompressing one frame.

Files are written through ``pyarrow.fs`` to ``out`` (any URI it knows; default a
folder below ``spark.checkpoint.dir``) under a name of the attempt and then moved to
the final name, so a lost executor leaves at most an unreferenced ``.tmp`` file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "2024-01-01T00:00:00Z"
INDEX = ("page_id long, record_id string, bundle string, frame int, frame_offset long, "
         "frame_size long, offset long, length long")


def record_id(page_id, url, digest: str) -> str:
    """Record identifiers are a function of the page, so reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def build_record(page_id, url, payload: bytes, digest: str, refers_to, refers_url) -> tuple[str, bytes]:
    """(record id, bytes) of one response or, with ``refers_to``, one revisit record."""
    rid = record_id(page_id, url, digest)
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
            "Content-Type: application/http; msgtype=response"]
    if url is not None:  # a header is one line
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", "WARC-Refers-To: " + record_id(refers_to, refers_url, digest),
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers in lower case, block, end) of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, data[start:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """[(offset, compressed size, decompressed size)] from the last bytes of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    size = 12 if flags & 0x80 else 8
    entries, out, at = data[-9 - n * size:-9], [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", entries, i * size)
        out.append((at, c, d))
        at += c
    return out


class _Bundle:
    """One file under construction: frames go out as they fill."""

    def __init__(self, fs, folder: str, name: str, tag: str, level: int):
        self.fs, self.path, self.tmp = fs, f"{folder}/{name}", f"{folder}/{name}.{tag}.tmp"
        self.out, self.name = fs.open_output_stream(self.tmp), name
        self.zip, self.frames, self.at = zstandard.ZstdCompressor(level=level), [], 0
        self.buffer, self.pending = bytearray(), []

    def add(self, page_id, rid: str, record: bytes) -> None:
        self.pending.append((page_id, rid, len(self.buffer), len(record)))
        self.buffer += record

    def flush(self) -> list[tuple]:
        if not self.pending:
            return []
        frame = self.zip.compress(bytes(self.buffer))
        rows = [(p, r, self.name, len(self.frames), self.at, len(frame), o, n) for p, r, o, n in self.pending]
        self.out.write(frame)
        self.frames.append((len(frame), len(self.buffer)))
        self.at += len(frame)
        self.buffer, self.pending = bytearray(), []
        return rows

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.tmp, self.path)


def _writer(out: str, frame_bytes: int, bundle_bytes: int, level: int):
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.int32() if x.split()[1] == "int" else pa.string()
             for x in INDEX.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        fs, folder = pafs.FileSystem.from_uri(out)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        part, tag, bundle, number = task.partitionId(), uuid.uuid4().hex, None, 0
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "_digest", "refers_to", "_refers_url"))):
                if bundle is None:
                    bundle = _Bundle(fs, folder, f"part-{part:06d}-{number:04d}.warc.zst", tag, level)
                payload = (x[2] or "").encode()
                bundle.add(x[0], *build_record(x[0], x[1], payload, *x[3:]))
                if len(bundle.buffer) >= frame_bytes and (rows := bundle.flush()):
                    yield batch(rows)
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle, number = None, number + 1
        if bundle is not None:
            if rows := bundle.flush():
                yield batch(rows)
            bundle.close()
    return write


def write_archives(pages: DataFrame, out: str | None = None, min_bytes: int = 1000,
                   frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28,
                   level: int = 3) -> tuple[str, DataFrame]:
    """Write one record per row of ``pages`` (page_id long, url, html); (folder, index).

    The payload is the html in UTF-8, null is empty.  Of pages with equal payloads of
    at least ``min_bytes`` the one with the largest page_id is a response and the
    others are revisits of it; repeated rows of that page are responses too (a record
    never revisits itself), and pages without an id are revisits unless no equal page
    has one.  A null url leaves the target out.  Extra columns are ignored; an empty
    table gives no bundles and an empty index.  A record longer than a frame is a
    frame of its own.
    """
    spark = pages.sparkSession
    s = Scratch(spark, "warc")
    out = out or f"{s.root}/bundles"
    body = F.coalesce("html", F.lit("")).cast("binary")
    digest = F.sha1(body)
    sized = F.octet_length(body)
    # only groups of equals travel: partial counts per digest, then those above one
    twins = s.table(
        pages.filter(sized >= min_bytes).groupBy(digest.alias("_twin"), sized.alias("_n"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(F.struct("page_id", "url")).alias("_keep"))
        .filter("_rows > 1").select("_twin", "_n", F.col("_keep")["page_id"].alias("_keep"),
                                    F.col("_keep")["url"].alias("_keep_url")), "twins")
    rows = pages.select("page_id", "url", "html", digest.alias("_digest"), sized.alias("_size"))
    rows = rows.join(twins, (F.col("_digest") == F.col("_twin")) & (F.col("_size") == F.col("_n")), "left")
    other = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    rows = rows.select("page_id", "url", "html", "_digest", F.when(other, F.col("_keep")).alias("refers_to"),
                       F.when(other, F.col("_keep_url")).alias("_refers_url"))
    return out, s.table(rows.mapInArrow(_writer(out, frame_bytes, bundle_bytes, level), INDEX), "index")


PARSED = ("page_id long, record_id string, target_uri string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long")


def _row(head: dict, block: bytes) -> tuple:
    cut = block.index(b"\r\n\r\n") + 4
    http = {k.lower(): v for k, v in (x.split(": ", 1) for x in block[:cut - 4].decode().split("\r\n")[1:])}
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "response" and hashlib.sha1(block[cut:]).hexdigest() != digest:
        raise ValueError("a payload does not have its digest")
    page, ref = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return (None if page is None else int(page), head["warc-record-id"], head.get("warc-target-uri"),
            head["warc-type"], int(http["content-length"]), digest, None if ref is None else int(ref))


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    cols = [x.split() for x in PARSED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.int64() if t == "long" else pa.string()) for v, (_, t) in zip(zip(*rows), cols)],
        [c for c, _ in cols])


#: Compressed bytes that one reading task is given.
READ_BYTES = 8 << 20


def read_archives(index: DataFrame, out: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """Every record of the bundles that ``index`` names, read back frame by frame from
    the bundles' own seek tables (the index only lists the files, and the bytes of their
    frames, from which follows the number of tasks).  Each task has a range of frames and
    opens a bundle once."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        fs, folder = pafs.FileSystem.from_uri(out)
        unzip, name, f, table = zstandard.ZstdDecompressor(), None, None, []
        for b in batches:
            for bundle, frame in zip(b.column("bundle").to_pylist(), b.column("frame").to_pylist()):
                if bundle != name:
                    if f is not None:
                        f.close()
                    name, f = bundle, fs.open_input_file(f"{folder}/{bundle}")
                    table = _entries(f)
                at, size, plain = table[frame]
                f.seek(at)
                data = unzip.decompress(f.read(size), max_output_size=plain)
                rows, here = [], 0
                while here < len(data):
                    head, block, here = parse_record(data, here)
                    rows.append(_row(head, block))
                if rows:
                    yield _parsed(rows)
        if f is not None:
            f.close()
    spark = index.sparkSession
    frames = index.groupBy("bundle", "frame").agg(F.max("frame_size").alias("size"))
    n, size = frames.agg(F.count(F.lit(1)), F.sum("size")).first()
    tasks = max(1, -(-(size or 0) // read_bytes), min(n, partitions(spark)))
    return (frames.select("bundle", "frame").repartitionByRange(tasks, "bundle", "frame")
            .sortWithinPartitions("bundle", "frame").mapInArrow(read, PARSED))


def _entries(f) -> list[tuple[int, int, int]]:
    """The seek table of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n = struct.unpack("<IBI", f.read(9))[0]
    f.seek(size - 9 - 8 * n)
    return read_seek_table(f.read(8 * n + 9))


def fetch_records(wanted: DataFrame, out: str) -> DataFrame:
    """The whole records (record_id, record) of some rows of the index: one frame is
    decompressed for each."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        fs, folder = pafs.FileSystem.from_uri(out)
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(f"{folder}/{r['bundle']}") as f:
                    at, size, plain = _entries(f)[r["frame"]]
                    f.seek(at)
                    data = unzip.decompress(f.read(size), max_output_size=plain)
                record = data[r["offset"]:r["offset"] + r["length"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["record_id"]]), pa.array([record], pa.binary())], ["record_id", "record"])
    return wanted.select("record_id", "bundle", "frame", "offset", "length").mapInArrow(
        read, "record_id string, record binary")
