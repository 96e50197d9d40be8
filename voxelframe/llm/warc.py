"""WARC archives (operator 10): one Zstandard frame per record, all with one dictionary.

An archive begins with a skippable frame that holds the dictionary (magic number
0x184D2A5D, as in the public WARC-Zstandard proposal), followed by one frame per
record. The dictionary is trained on a bounded sample of the records, whole
and as they are written. Payloads that repeat an earlier-chosen record are written as revisits
without a body. Records are WARC/1.1: a response holds an HTTP response whose
entity is the payload.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from voxelframe.llm.common import lean, lookup, prepare_workers, saved, scratch

SKIPPABLE = 0x184D2A5D
REVISIT_BYTES = 1000  # payloads below this are always stored
SAMPLE_ROWS = 1000  # about as many records the dictionary is trained on, at most
SAMPLE_BYTES = 16 << 20  # about as many bytes of html among them, at most
SAMPLE_PAGE = 4 << 20  # a longer html is archived like any other, but the dictionary is not trained on it
SAMPLE_SEED = 10
DICTIONARY_BYTES = 65_536
LEVEL = 3
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow can write to: a local path or a URI."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; empty if the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


NO_URL = "urn:page:"  # stands for a null url, since every record must have a target
EPOCH = "1970-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_to_url: str | None = None, date: str = EPOCH) -> bytes:
    """One WARC record under an id of its own. A revisit keeps the payload's digest and length in its header and has no body."""
    target = lambda u: NO_URL if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    body = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target(url)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {target(refers_to_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload (of a revisit: none) of each record of a compressed archive, frame by frame in bounded memory."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    source = _Joined(head, stream)
    with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True) as plain:
        text = io.BufferedReader(plain, 1 << 20)
        while line := text.readline():
            if line.strip() != VERSION.encode():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := text.readline().rstrip(b"\r\n")) != b"":
                key, _, value = line.decode("utf-8").partition(": ")
                headers[key] = value
            body = text.read(int(headers.get("Content-Length", -1)))
            if len(body) != int(headers.get("Content-Length", -1)) or text.read(4) != b"\r\n\r\n":
                raise ValueError("the archive ends inside a record")
            yield headers, body.partition(b"\r\n\r\n")[2]


class _Joined(io.RawIOBase):
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(n)


def _hashed(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html").withColumns({"payload_digest": F.sha1(body), "payload_bytes": F.octet_length(body).cast("long")})


PAYLOAD = ["payload_digest", "payload_bytes"]


def repeated_payloads(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``(payload_digest, payload_bytes, chosen, chosen_url)``: the largest page_id of each payload that occurs more than once."""
    large = _hashed(pages).where(F.col("payload_bytes") >= least_bytes).groupBy(*PAYLOAD)
    most = large.agg(F.max(F.struct("page_id", "url")).alias("most"), F.count("*").alias("n")).where("n > 1 and most.page_id is not null")
    return saved(most.select(*PAYLOAD, F.col("most.page_id").alias("chosen"), F.col("most.url").alias("chosen_url")), "responses")


def choose_responses(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds ``payload_digest``, ``payload_bytes``, ``refers_to`` and ``refers_to_url``: the largest page_id with an equal payload, null if that is the row's own.

    Payloads are compared by SHA-1 and length. Rows that share the largest
    page_id are all responses; a null page_id never is the largest.
    """
    joined = lookup(_hashed(pages), repeated, PAYLOAD)
    again = ~F.col("chosen").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", *PAYLOAD, F.when(again, F.col("chosen")).alias("refers_to"), F.when(again, F.col("chosen_url")).alias("refers_to_url"))


def sample_records(pages: DataFrame, repeated: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[bytes]:
    """A bounded sample of whole records as they are written, even over the rows, whatever page ids these share."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    n, total = pages.agg(F.count("*"), F.sum(F.when(size <= SAMPLE_PAGE, size))).first()
    share = min(1.0, rows / max(n, 1), most / max(total or 0, 1))
    picked = pages.select("page_id", "url", "html").where((size <= SAMPLE_PAGE) & (F.rand(SAMPLE_SEED) < share))
    found = choose_responses(picked, repeated).collect()
    return [record(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_digest"], r["refers_to"], r["refers_to_url"]) for r in found]


WRITTEN = ("page_id", "url", "html", "payload_digest", "refers_to", "refers_to_url")


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, run_id: str, level: int = LEVEL) -> DataFrame:
    """Write rows of :data:`WRITTEN`, one archive per task; returns ``(path, records)``.

    A task writes under the name of its run, partition and attempt and renames
    at the end. What failed or repeated attempts leave is not in the manifest,
    and :func:`sweep` removes it.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = filesystem(folder)
        store.create_dir(inner, recursive=True)
        task = TaskContext.get()
        name = f"{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        n, out = 0, None
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        for b in batches:
            for key, url, html, digest, target, target_url in zip(*(b.column(c).to_pylist() for c in WRITTEN), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{inner}/{name}.part", compression=None)
                    if dictionary:
                        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                out.write(packer.compress(record(key, url, (html or "").encode(), digest, target, target_url, date)))
                n += 1
        if out is not None:
            out.close()
            store.move(f"{inner}/{name}.part", f"{inner}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    prepare_workers(pages.sparkSession)
    return pages.select(*WRITTEN).mapInArrow(lean(run), "path string, records long")


def sweep(folder: str, run_id: str, manifest: DataFrame) -> None:
    """Remove files of the run that the manifest does not list: one name per task is compared, no record is read."""
    store, inner = filesystem(folder)
    listed = {r["path"].rsplit("/", 1)[1] for r in manifest.select("path").collect()}
    for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if f.base_name.startswith(f"{run_id}-") and f.base_name not in listed:
            store.delete_file(f.path)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives ``(path, records)``; digest and length of a stored payload are taken from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                store, inner = filesystem(path)
                rows: list[tuple] = []
                n = 0
                with store.open_input_stream(inner, compression=None) as stream:
                    for h, body in read_archive(stream):
                        revisit = h["WARC-Type"] == "revisit"
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{path}: damaged payload in {h['WARC-Record-ID']}")
                        page, target = (h.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        url = h["WARC-Target-URI"]
                        n += 1
                        rows.append((None if page is None else int(page), None if url == NO_URL else url, int(h["X-Payload-Length"]) if revisit else len(body), digest, h["WARC-Type"], None if target is None else int(target), body if with_payload else None))
                        if len(rows) == 1000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)
                if n != records:
                    raise ValueError(f"{path}: {n} records where {records} were written")

    out = archives.select("path", "records").mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if with_payload else out.drop("payload")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def archive(pages: DataFrame, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write all pages to archives in ``folder`` (the shared folder by default), read them back, return their records.

    A null html is an empty payload; null page ids and urls survive; repeated
    rows are written as often as they occur; other columns are ignored. An empty
    table gives no archive and no record. Page ids must be integers.
    """
    if not isinstance(pages.schema["page_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError("page ids must be integers")
    folder = folder or scratch(pages.sparkSession, "warc")
    repeated = repeated_payloads(pages)
    dictionary = train_dictionary(sample_records(pages, repeated))
    run_id = uuid.uuid4().hex
    manifest = saved(write_archives(choose_responses(pages, repeated), folder, dictionary, run_id), "manifest")
    sweep(folder, run_id, manifest)
    n = manifest.count()
    return read_archives(manifest.repartition(max(1, n)), with_payload)
