"""WARC archives in Zstandard: a leading skippable frame holds the dictionary, each record is a frame of its own.

Writing. A page's payload is its html in UTF-8. Of the pages with one payload of at least MIN_REVISIT bytes, the one with the
smallest id becomes a response record, the others revisit records that refer to it. Frames go out through Spark's text
writer, whose line separator is set to an empty skippable frame: the files are valid Zstandard streams, land on any file
system that Spark can write to, and pass Spark's commit protocol, so a lost executor leaves no half archive.

Reading. Archives come through the binaryFile source, one per row. Block headers give each frame's length without
decoding; a frame is decoded with the archive's dictionary and must hold exactly one record, whose version line,
required headers, Content-Length, closing bytes and payload digest are checked. A damaged record gives a row with
``error`` set, and so does the rest of an archive whose frames cannot be told apart.

Defined results: a null html counts as empty; payloads under MIN_REVISIT bytes are all responses. A page without id is always a
response. Repeated rows give a record each; copies of the row with the smallest id are responses. A null url leaves the target out. An
empty table writes no archive and reads as an empty result. Columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import checkpointed, map_batches, new_folder

MIN_REVISIT = 100
#: Payload bytes that go into one archive, about; a reading task holds one archive.
ARCHIVE_BYTES = 32 << 20
#: Pages from which the dictionary is made, and bytes taken of each.
SAMPLE_PAGES = 400
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 32_768
#: Magic numbers of the format (fixed values).
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
FULL_DICTIONARY = 0xEC30A437
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE_FIRST, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Emitted in batches of about so many payload bytes.
BATCH_BYTES = 8 << 20

RECORDS = pa.schema([
    ("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("record_date", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
])


class Damaged(Exception):
    pass


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    full = len(data) >= 8 and struct.unpack("<I", data[:4])[0] == FULL_DICTIONARY
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(data)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, digest: str, payload: bytes | int, refers_to: str | None) -> bytes:
    """One WARC record around an HTTP response; a revisit keeps the response's head only, and needs the payload's length only."""
    body = payload if isinstance(payload, bytes) else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(body) if isinstance(payload, bytes) else payload)
    block = http + body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the frame that starts at ``at``, from its header and its blocks' headers."""
    if at + 8 > len(data):
        raise Damaged("frame cut short")
    magic = struct.unpack_from("<I", data, at)[0]
    if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME_MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise Damaged("frame cut short")
            head = data[end] | data[end + 1] << 8 | data[end + 2] << 16
            last, kind = bool(head & 1), head >> 1 & 3
            if kind == 3:
                raise Damaged("reserved block type")
            end += 3 + (1 if kind == 1 else head >> 3)
        end += 4 * (flags >> 2 & 1)
    else:
        raise Damaged(f"no frame at byte {at}")
    if end > len(data):
        raise Damaged("frame cut short")
    return end - at


def headers_of(lines: list[str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Damaged("malformed header line")
        found.setdefault(name.lower(), value.strip())
    return found


def parse_record(data: bytes) -> dict:
    """The columns of one record, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise Damaged("no end of headers")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/1."):
        raise Damaged("no WARC version line")
    h = headers_of(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise Damaged(f"no {name}")
    if not h["content-length"].isdigit():
        raise Damaged("content-length is no number")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("content-length does not match")
    block = rest[:n]
    out = {"record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"), "record_date": h["warc-date"], "refers_to": h.get("warc-refers-to", "").strip("<>") or None}
    payload, size = block, n
    if h.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("no end of HTTP headers")
        size = len(payload)
        stated = headers_of(http.decode("iso-8859-1").split("\r\n")[1:]).get("content-length")
        if stated is not None and h["warc-type"] == "revisit":
            size = int(stated)
        elif stated is not None and int(stated) != size:
            raise Damaged("HTTP content-length does not match")
    stated = h.get("warc-payload-digest", "")
    digest = stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
    if h["warc-type"] != "revisit":
        found = hashlib.sha256(payload).hexdigest()
        if digest is not None and digest != found:
            raise Damaged("payload digest does not match")
        digest = found
    elif out["refers_to"] is None:
        raise Damaged("revisit without warc-refers-to")
    return out | {"payload_digest": digest, "payload_bytes": size, "payload": payload if h["warc-type"] != "revisit" else None}


def records(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            n = frame_length(view, at)
        except Damaged as why:
            yield {"error": f"{why}; the rest of the archive is not read"}
            return
        frame = view[at : at + n]
        magic = struct.unpack_from("<I", frame, 0)[0]
        try:
            if magic == DICTIONARY_MAGIC and at == 0:
                body = bytes(frame[8:])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                reader = zstandard.ZstdDecompressor(dict_data=as_dictionary(body))
            elif magic == FRAME_MAGIC:
                yield parse_record(reader.decompressobj().decompress(frame))
        except (Damaged, zstandard.ZstdError, ValueError) as why:
            yield {"error": str(why)}
        at += n


def read_archives(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """A row per record of the archives under ``path``; see RECORDS."""
    source = spark.read.format("binaryFile")
    source = source.option("pathGlobFilter", pattern) if pattern else source
    files = source.load(path).where("length > 0").select("path", "content")

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            name, rows, held = batch.column(0)[k].as_py(), [], 0
            for record in records(batch.column(1)[k].as_py()):
                rows.append(record | {"archive": name})
                held += len(record.get("payload") or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return map_batches(files, decode, RECORDS)


def _with_digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(page_id, payload_bytes, digest) of pages."""
    bodies = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, bodies)), pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string())], schema=DIGESTS)


DIGESTS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())])
FRAMES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("frame", pa.binary())])


def record_writer(dictionary: bytes) -> zstandard.ZstdCompressor:
    with_dictionary = {"dict_data": as_dictionary(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=6, write_checksum=True, write_content_size=True, **with_dictionary)


def revisits(digests: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has."""
    known = digests.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least)).select("page_id", "digest")
    first = checkpointed(known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return known.distinct().join(first, "digest").where("page_id <> refers_to")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes ``pages`` as archives under ``path``. The html is shuffled once, by page id and digest, into even parts."""
    spark = pages.sparkSession
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    digests = checkpointed(map_batches(narrow.select("page_id", "html"), _with_digest, DIGESTS))
    total = digests.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    ids = [r.page_id for r in digests.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(SAMPLE_PAGES).collect()]
    samples = [r.html.encode("utf-8", "surrogatepass") for r in narrow.where(F.col("page_id").isin(ids)).select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("html")).orderBy("page_id", "html").limit(SAMPLE_PAGES).collect() if r.html]
    dictionary = train_dictionary(samples) if samples else b""
    repeats = revisits(digests).withColumnRenamed("page_id", "r_id").withColumnRenamed("digest", "r_digest")
    same = (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest"))

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = record_writer(dictionary)
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((page_id, url, len(payload), digest, writer.compress(record_bytes("response", f"urn:page:{page_id}", url, date, digest, payload, None))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FRAMES)], schema=FRAMES)

    # Frames are made before the shuffle, which so moves as many bytes as the archives hold.
    made = narrow.mapInArrow(responses, from_arrow_schema(FRAMES))
    dealt = made.repartition(parts, "page_id", "digest").join(repeats.hint("shuffle_hash"), same, "left").select("page_id", "url", "payload_bytes", "digest", "frame", "refers_to")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, began = record_writer(dictionary), False
        for batch in batches:
            out = [] if began or not batch.num_rows or not dictionary else [dictionary_frame(dictionary)]
            began = began or batch.num_rows > 0
            for page_id, url, size, digest, frame, refers in zip(*[c.to_pylist() for c in batch.columns]):
                again = refers is not None and record_bytes("revisit", f"urn:page:{page_id}", url, date, digest, size, f"urn:page:{refers}")
                out.append(writer.compress(again) if again else frame)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    dealt.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


def page_id_of(column: str) -> "F.Column":
    """The id in a record id that write_archives gave."""
    return F.expr(f"try_cast(substring({column}, {len('urn:page:') + 1}) as bigint)")
