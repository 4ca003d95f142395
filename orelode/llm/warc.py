"""Archives of web pages: WARC records in Zstandard frames, with a dictionary of their own in front.

Each task writes archives of a bounded size. The dictionary of an archive is built from
its own records and stands, as a skippable frame, before them; every record is then a
frame by itself. A record with the payload of another is a revisit that refers to it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.shared import settle
from orelode.session import work_folder

#: Payload bytes after which a task begins a new archive; bounds what it holds in memory.
ARCHIVE_BYTES = 16_000_000
#: The dictionary's size, and how many bytes of evenly spaced records of the archive it is built from.
DICTIONARY_BYTES = 65_536
TRAINING_BYTES = 2_000_000
LEVEL = 6
#: Shorter payloads are always written in full.
REVISIT_BYTES = 100
#: Slices of a payload digest with many copies when its rows meet the first of them.
SLICES = 32

# The magic number of a skippable frame with a dictionary, and the profile of revisits.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def originals(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has; one row for each such page.

    The digests are counted in the map tasks and only those with copies are looked up, in
    slices, so that one payload with a third of all pages is spread over many tasks.
    """
    rows = pages.select("page_id", "payload").where(
        (F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select(
        "page_id", F.sha2("payload", 256).alias("digest")).distinct()
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("page_id"), F.lit(SLICES)).cast("int"))
    return rows.join(first, ["digest", "slice"]).where("page_id <> refers_to").select(
        "page_id", "digest", "refers_to")


def record_id(page_id: int | None, url: str | None) -> str:
    name = f"{url}" if page_id is None else f"page {page_id}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str) -> bytes:
    """One WARC record; a revisit has the headers of its response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
              f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, None)}",
                  f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from evenly spaced records; too few to train on serve as they are."""
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    sample = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        raw = b"".join(sample)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """An archive file: the dictionary in a skippable frame, then a frame for each record."""
    words = dictionary(records)
    head = words.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
    words.precompute_compress(level=LEVEL)
    return struct.pack("<II", SKIPPABLE, len(head)) + head + b"".join(map(compressor.compress, records))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive file."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary")
    words = zstandard.ZstdCompressionDict(data[8:8 + size])
    frames = io.BytesIO(data)
    frames.seek(8 + size)
    reader = io.BufferedReader(
        zstandard.ZstdDecompressor(dict_data=words).stream_reader(frames, read_across_frames=True), 1 << 20)
    while reader.readline():
        headers = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name.lower()] = value
        block = reader.read(int(headers["content-length"]))
        reader.read(4)
        yield headers, block


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, url, payload binary) as archives into ``folder``, a URI all executors reach.

    Returns the manifest (``file``, ``records``) as a written table. Archives carry the attempt
    of their task in the name, and only those in the manifest count: a task that is lost or
    runs twice leaves at most a file that nobody reads. Pages move once, by their id.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(originals(pages), ["page_id", "digest"], "left").select(
        "page_id", "url", "payload", "digest", "refers_to")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        held: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            name = f"{path}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
            with files.open_output_stream(name, compression=None) as out:
                out.write(archive(held))
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return settle(rows.mapInArrow(archives, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``manifest``; an archive is read by one task.

    Length and digest of responses are taken from their payload as read, those of revisits
    from their headers. Without ``payloads`` that column is null.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(folder)
        names = READ.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(name, compression=None) as source:
                    data = source.read()
                rows = []
                for headers, block in parse(data):
                    kind, refers = headers["warc-type"], headers.get("x-refers-to-page")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    page = headers.get("x-page-id")
                    rows.append((
                        None if page is None else int(page),
                        int(headers["x-payload-length"]) if payload is None else len(payload),
                        headers["warc-payload-digest"].removeprefix("sha256:") if payload is None
                        else hashlib.sha256(payload).hexdigest(),
                        kind, None if refers is None else int(refers), headers.get("warc-target-uri"),
                        payload if payloads else None))
                    if len(rows) == 500:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("file").repartition(tasks, "file").mapInArrow(records, READ)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False,
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes every page as a WARC record and reads the archives back: a row for each row of ``pages``.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest
    id is the response and the others are revisits of it. A null html is an empty payload; a
    null url is left out of its record. A page without id is always a response. Rows that
    repeat the smallest id of a payload are all responses. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    folder = folder or work_folder(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    found = read(write(rows, folder), folder, payloads)
    return found if payloads else found.drop("payload", "url")
