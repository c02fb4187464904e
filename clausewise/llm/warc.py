"""WARC archives compressed with a shared Zstandard dictionary (operator 7).

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record is one Zstandard frame made with it.  Records are made
in Arrow batches and written by Spark's own text writer, so that its commit
protocol applies and any store that Spark writes to will do: the bytes of a
frame are the line, and the line separator is an empty skippable frame, which
every reader of the format passes over.  An archive ends at ``ARCHIVE_BYTES``: the
writer is told to begin a file every ``ARCHIVE_LINES`` lines, and the task that
has made so many bytes fills the file up with empty lines, that is separators, and
leads the next one with the dictionary.  So an archive is never larger than that
bound, one record and the separators.  Tasks are merged as far as an archive's
size, so that small partitions do not give small archives.

The reader takes whole files with Spark's ``binaryFile`` source, loads the
dictionary from the leading frame, walks the frames by their block headers and
decodes one at a time.  It validates the version line, the mandatory headers,
``Content-Length`` against the block, the end of the record and the payload
digest.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
smallest id is a response; the others are revisits that carry the HTTP header
and refer to it.  The groups are found by their SHA-1 over ids and hashes alone;
what a group of two and more decides goes back to its ids, and html is joined
with it by id and hash, so that pages with one payload are spread over all tasks.

Defined cases: a null html is an empty payload; a null id is larger than any
other and has an empty place in the record id; rows that repeat the smallest id
of a group are all responses; line breaks in a url are percent-encoded, a null
url has no target header; an empty table gives archives without records; a
record of more than ``MAX_RECORD`` bytes is refused when it is written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.session import cut_lineage, ship_package

# Fixed values of the formats.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
#: An empty skippable frame, all ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE_FIRST, 0).decode("ascii")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

SAMPLE_PAGES = 400
SAMPLE_CHARS = 16_000
DICTIONARY_BYTES = 32_768
MAX_RECORD = 1 << 30
#: Bytes at which an archive ends, and the lines (records, or separators to fill up) of a file.
ARCHIVE_BYTES = 32_000_000
ARCHIVE_LINES = 32_768
_ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# ---------------------------------------------------------------- records

def make_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, is_revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{_ID}{page_id or ''}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to or ''}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header line: {line[:80]!r}")
        out[name.strip()] = value.strip()
    return out


def _page(uri: str | None) -> str | None:
    m = re.fullmatch(rf"<{_ID}(.*)>", uri or "", re.DOTALL)
    return m.group(1) or None if m else uri


def parse_record(data: bytes) -> dict:
    """Fields of one validated record."""
    first, _, rest = data.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    head, blank, body = rest.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("the header does not end")
    fields = _fields(head)
    if missing := [k for k in MANDATORY if k not in fields]:
        raise ValueError(f"without {', '.join(missing)}")
    size = fields["Content-Length"]
    if not size.isdigit() or len(body) != int(size) + 4 or body[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size}, but {len(body) - 4} bytes of block")
    block = body[:-4]
    out = {"record_type": fields["WARC-Type"], "record_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
           "date": fields["WARC-Date"], "refers_to": _page(fields.get("WARC-Refers-To")), "payload_digest": None, "payload_bytes": None, "payload": None}
    if out["record_type"] in ("response", "revisit"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        status, _, lines = http.partition(b"\r\n")
        if not blank or not status.startswith(b"HTTP/"):
            raise ValueError("the block is not an HTTP message")
        out["payload_bytes"] = int(_fields(lines)["Content-Length"])
        out["payload_digest"] = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        if out["record_type"] == "response":
            if len(payload) != out["payload_bytes"] or payload_digest(payload) != out["payload_digest"]:
                raise ValueError("the payload does not have its length and digest")
            out["payload"] = payload
        elif payload or fields.get("WARC-Profile") != REVISIT_PROFILE or "WARC-Refers-To" not in fields:
            raise ValueError("not a revisit of an identical payload")
    return out


# ---------------------------------------------------------------- frames

def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    here = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if here + 3 > len(data):
            raise ValueError("the frame is cut short")
        block = int.from_bytes(data[here:here + 3], "little")
        kind, size = block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a block of a reserved kind")
        here += 3 + (1 if kind == 1 else size)
        if block & 1:
            break
    here += 4 * (flags >> 2 & 1)
    if here > len(data):
        raise ValueError("the frame is cut short")
    return here


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """Magic, start and end of every frame; of a skippable one, of its content."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            end = at + 8 + size
            if end > len(data):
                raise ValueError("the frame is cut short")
            yield magic, at + 8, end
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield magic, at, end
        else:
            raise ValueError(f"no frame begins at byte {at}")
        at = end


def read_archive(content: bytes | memoryview) -> Iterator[dict]:
    """Validated records of one archive, decoded one frame at a time."""
    data = memoryview(content)
    decoder = None
    for magic, start, end in frames(data):
        if magic == DICTIONARY_MAGIC and decoder is None:
            raw = bytes(data[start:end])
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
        elif magic == FRAME_MAGIC:
            if decoder is None:
                raise ValueError("no dictionary frame leads the archive")
            yield parse_record(decoder.decompress(data[start:end], max_output_size=MAX_RECORD))


# ---------------------------------------------------------------- Spark

def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from the beginnings of a bounded sample of pages; empty when they are too few to train on."""
    few = pages.select(F.substring(html, 1, SAMPLE_CHARS).alias("h")).filter("h != ''").limit(SAMPLE_PAGES).collect()
    samples = [r["h"].encode("utf-8") for r in few]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def with_record_type(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds ``_first``: the smallest id of the pages with the same payload (null: a response)."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    digest = F.when(F.octet_length(body) >= min_bytes, F.sha1(body))
    narrow = cut_lineage(pages.select(F.col(page_id).alias("_id"), digest.alias("_sha1"))).filter(F.col("_sha1").isNotNull())
    groups = narrow.groupBy("_sha1").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # one row for each id and payload of a group; ids that repeat are one row here
    decided = narrow.distinct().join(groups, "_sha1").select(F.col("_sha1").alias("_of"), F.col("_id").alias("_at"), "_first")
    x = pages.withColumn("_sha1", digest)
    return x.join(decided, (F.col("_sha1") == F.col("_of")) & F.col(page_id).eqNullSafe(F.col("_at")), "left").drop("_sha1", "_of", "_at")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
                   dictionary: bytes | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 3,
                   archive_bytes: int = ARCHIVE_BYTES, archive_lines: int = ARCHIVE_LINES) -> None:
    spark = pages.sparkSession
    ship_package(spark)
    known = train_dictionary(pages, html) if dictionary is None else dictionary
    pages = pages.select(page_id, url, html)
    size = pages.agg(F.sum(F.octet_length(html) + 500)).first()[0] or 0
    typed = with_record_type(pages, page_id, html, min_bytes)
    rows = typed.select(F.col(page_id).cast("string").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.col("_first").cast("string").alias("first"),
                        (F.col("_first").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("_first"))).alias("revisit"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = (zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known), write_checksum=True) if known
                   else zstandard.ZstdCompressor(level=level, write_checksum=True))
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(known)) + known
        lines, held = 0, 0  # of the archive that is being written

        def frame(r: dict) -> bytes:
            record = make_record(r["id"], r["url"], (r["html"] or "").encode("utf-8"), r["first"], r["revisit"], date)
            if len(record) > MAX_RECORD:
                raise ValueError(f"a record of {len(record)} bytes, more than {MAX_RECORD}")
            return encoder.compress(record)

        yield pa.record_batch({"frame": pa.array([lead], pa.binary())})
        lines = 1
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made: list[bytes] = []
                for r in batch.slice(at, 64).to_pylist():
                    if lines >= archive_lines or held >= archive_bytes:
                        made += [b""] * (archive_lines - lines) + [lead]
                        lines, held = 1, 0
                    made.append(frame(r))
                    lines += 1
                    held += len(made[-1])
                yield pa.record_batch({"frame": pa.array(made, pa.binary())})

    # html compresses to a part of its size, so a task of this much makes one archive
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // archive_bytes))
    (rows.coalesce(tasks).mapInArrow(make, "frame binary").select(F.col("frame").cast("string").alias("value"))
         .write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", archive_lines).mode("errorifexists").text(path))


RECORD = ("record_type string, record_id string, url string, date string, refers_to string, payload_digest string, "
          "payload_bytes bigint, payload binary")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; ``payload=False`` leaves the payloads out after validating them.

    Every archive is one value of the ``binaryFile`` source, which the writer bounds; a task holds one batch of them."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in RECORD.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in read_archive(content.as_buffer()):
                    if not payload:
                        record["payload"] = None
                    held.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(parse, RECORD)
