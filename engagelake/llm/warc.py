"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Spark's own text writer commits the archives, so they reach any store Spark can write to, and a task that fails leaves
nothing behind: each row is one archive as raw bytes, one row makes one file, and the line separator after it is an
empty skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, shared_folder, stored

# Fixed values of the formats: Zstandard frame magics, the WARC version line and profile.
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SKIPPABLE = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")
EMPTY_SKIPPABLE = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes after which an archive is closed, payload bytes to train a dictionary on, and its largest size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 32 << 10
#: Bytes that a record may claim to hold once decoded.
RECORD_LIMIT = 1 << 30
#: Smaller payloads are always stored.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, "
    "payload binary, problem string"
)


def record(record_id: str, kind: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header of its response, which states the length, without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri:
        # Control characters and what is not ASCII would break the header.
        head.append("WARC-Target-URI: " + "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records, or None where they are too few or too small."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def archives(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives of about ``archive_bytes``, all with the dictionary trained on the first records."""
    first: list[bytes] = []
    held = 0
    for one in records:
        first.append(one)
        held += len(one)
        if held >= SAMPLE_BYTES:
            break
    if not first:
        return
    dictionary = train([r[:SAMPLE_BYTES // 8] for r in first])
    lead = b""
    if dictionary is not None:
        raw = dictionary.as_bytes()
        lead = DICTIONARY_MAGIC + len(raw).to_bytes(4, "little") + raw
        dictionary.precompute_compress(level=3)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    out = bytearray(lead)

    def rest():
        yield from first
        first.clear()
        yield from records

    for one in rest():
        out += packer.compress(one)
        if len(out) >= archive_bytes:
            yield bytes(out)
            out = bytearray(lead)
    if len(out) > len(lead):
        yield bytes(out)


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (record_id, record_type, target_uri, payload, payload_digest, refers_to) as archives.

    Null payloads are empty; null ids become urn:uuid:0. Every archive holds whole records, each in a frame of its own.
    An empty table leaves a folder without records.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for r in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                    yield record(r[0] or "urn:uuid:0", r[1], r[2], r[3] or b"", r[4], r[5])

        for archive in archives(records(), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])

    names = ["record_id", "record_type", "target_uri", "payload", "payload_digest", "refers_to"]
    packed = pages.select(*names).mapInArrow(pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", EMPTY_SKIPPABLE).option(
        "maxRecordsPerFile", 1).text(folder)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends: header, blocks, checksum."""
    head = bytes(data[at:at + 18])
    params = zstandard.get_frame_parameters(head)
    pos = at + zstandard.frame_header_size(head)
    while True:
        if pos + 3 > len(data):
            raise ValueError("frame is cut off")
        block = int.from_bytes(data[pos:pos + 3], "little")
        last, kind, size = block & 1, (block >> 1) & 3, block >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        pos += 3 + (1 if kind == 1 else size)
        if last:
            break
    pos += 4 if params.has_checksum else 0
    if pos > len(data):
        raise ValueError("frame is cut off")
    return pos


def frames(data: bytes, limit: int = RECORD_LIMIT) -> Iterator[bytes]:
    """The decoded frames of an archive. The dictionary comes from the leading skippable frame, itself packed or plain."""
    view, at, plain = memoryview(data), 0, None
    unpacker = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at:at + 4])
        if SKIPPABLE.fullmatch(magic):
            size = int.from_bytes(view[at + 4:at + 8], "little")
            if at + 8 + size > len(view):
                raise ValueError("skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                plain = bytes(view[8:8 + size])
                if plain[:4] == FRAME_MAGIC:
                    plain = zstandard.ZstdDecompressor().decompress(plain, max_output_size=limit)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("neither a frame nor a skippable frame")
        end = frame_end(view, at)
        frame = view[at:end]
        claimed = zstandard.frame_content_size(bytes(frame[:18]))
        if claimed > limit:
            raise ValueError(f"a record claims {claimed} bytes")
        yield unpacker.decompress(frame) if claimed >= 0 else unpacker.decompress(frame, max_output_size=limit)
        at = end


def _fields(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+.0-9A-Z^-z|~-]+", name):
            raise ValueError("malformed header line")
        found.setdefault(name.decode().lower(), value.strip().decode("utf-8"))
    return found


def parse(raw: bytes) -> tuple:
    """(record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, payload) of a record, all checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version != VERSION:
        raise ValueError("no WARC header")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content-length does not match the record")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    answer = _fields(http.partition(b"\r\n")[2])
    if not gap or not http.startswith(b"HTTP/") or not answer.get("content-length", "").isdecimal():
        raise ValueError("no HTTP header with a length")
    size, kind = int(answer["content-length"]), fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    refers_to = fields.get("warc-refers-to")
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload does not match its length or digest")
    elif kind != "revisit" or payload or not refers_to or not digest:
        raise ValueError("neither a response nor a revisit")
    return (fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), digest, size,
            refers_to.strip("<>") if refers_to else None, payload if kind == "response" else None)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """Every record of the archives in ``folder``, checked: frames, header lines, lengths and digests.

    ``strict`` fails on the first bad record; otherwise it becomes a row with its ``problem``, and a frame that cannot be
    found ends its archive. ``payloads=False`` leaves them out after the check.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            (n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string()))
            for n, t in (c.split() for c in RECORD_SCHEMA.split(", "))])

        def rows(data: bytes):
            found = frames(data)
            while True:
                try:
                    raw = next(found, None)
                    if raw is None:
                        return
                    values = parse(raw)
                    yield (*(values if payloads else (*values[:-1], None)), None)
                except (ValueError, zstandard.ZstdError) as error:
                    if strict:
                        raise
                    yield (*[None] * 7, str(error))

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for data in batch.column(0):
                some, held = [], 0
                for row in rows(data.as_py()):
                    some.append(row)
                    held += len(row[6] or b"") + 300
                    if held > 4 << 20:
                        yield batch_of(some)
                        some, held = [], 0
                if some:
                    yield batch_of(some)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(unpack, RECORD_SCHEMA)


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Add record_type and refers_to to pages (page_id, payload, payload_digest).

    Of equal payloads of at least ``revisit_bytes`` the largest page_id is the response, and the others revisit it.
    Rows that share that page_id are responses all; without any page_id in the group, so are all its rows.
    Only digests that occur twice are kept as a table; it is stored, so that adaptive execution can split a hot one.
    """
    large = F.octet_length("payload") >= revisit_bytes
    twice = pages.where(large).groupBy(F.col("payload_digest").alias("__digest")).agg(
        F.max("page_id").alias("__last"), F.count("*").alias("__n")).where("__n > 1 and __last is not null").drop("__n")
    key = F.when(large, F.col("payload_digest")).otherwise(F.xxhash64("page_id").cast("string"))
    joined = pages.withColumn("__key", key).join(stored(twice, "responses"), F.col("__key") == F.col("__digest"), "left")
    again = F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("__last"))).drop("__key", "__digest", "__last")


@query("op1_warc")
def _warc(spark, folder):
    """All pages written as archives and read back; a null html is an empty payload, a null page_id stays null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = read(spark, folder, "pages").select("page_id", "url", payload.alias("payload"))
    pages = with_revisits(pages.withColumn("payload_digest", F.sha1("payload")))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    target = shared_folder(spark, "warc")
    write_warc(pages.select(
        urn("page_id").alias("record_id"), "record_type", F.col("url").alias("target_uri"), "payload", "payload_digest",
        urn("refers_to").alias("refers_to")), target)
    number = lambda c: F.expr(f"case when {c} like 'urn:page:%' then try_cast(substring({c}, 10) as bigint) end")
    return read_warc(spark, target, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
