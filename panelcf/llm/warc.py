"""WARC archives with a two-level capture index.

Pages become records in WARC files, one gzip member each, written by many tasks into the shared folder. The index has two levels:
all captures sorted by URL key (host labels reversed) in compressed blocks, and per index file a sparse directory with the first key of each
block. A lookup finds the files by their first keys, binary-searches the directory, reads the blocks it needs by range, and
binary-searches their lines; a replay reads the record itself by range.

Files carry a name of their own per attempt and count only if the task's rows name them, so repeated tasks leave no doubles.

Defined results: null html is the empty payload, a null URL the key "-", a null page_id is kept as null; rows with the same id and
payload are all responses if one is; a broken URL keeps its text as its key.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import sys
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.llm.common import shared_path, stored

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A WARC file is closed when it has grown past this.
FILE_BYTES = 256 << 20
BLOCK_LINES = 1000
#: Records of a file read by one task of a replay.
SPAN_BYTES = 16 << 20

CAPTURE = "urlkey string, url string, page_id long, type string, digest string, file string, offset long, length long"
_FIELDS = ("url", "page_id", "type", "digest", "file", "offset", "length")


def url_key(url: str | None) -> str:
    """Reversed host, port if unusual, path and query; without scheme and fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="!$&'()*+,/:;=?@[]~%")
    port = "" if port in (None, 80, 443) else f":{port}"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + port + ")" + path, safe="!$&'()*+,/:;=?@[]~%")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with a response, or with a revisit if ``refers_to`` is given: HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", WARC_DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")))
    if revisit:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(_header(lines) + body + b"\r\n\r\n") + pack.flush()


def read_record(member: bytes) -> dict:
    """Headers, HTTP head and payload of a gzip member; checks the lengths and, of a response, the digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(rest) != len(body) + 4:
        raise ValueError("a record is longer or shorter than its header says")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (size != len(payload) or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "digest": digest, "payload_bytes": size, "payload": payload,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


class _File:
    """An output file that takes pieces and tells where each begins."""

    def __init__(self, folder: str, name: str):
        self.system, path = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.name, self.at = f"{folder}/{name}-{uuid.uuid4().hex}", 0
        self.out = self.system.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}", compression=None)

    def put(self, piece: bytes) -> tuple[int, int]:
        self.out.write(piece)
        self.at += len(piece)
        return self.at - len(piece), len(piece)

    def close(self) -> None:
        self.out.close()


class _Reader:
    """Range reads, the last file kept open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            system, path = pafs.FileSystem.from_uri(name)
            self.name, self.file = name, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_CAPTURE = pa.schema([("urlkey", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("digest", pa.string()),
                      ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages; returns the captures (CAPTURE), stored.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the smallest page_id is the response and the
    others revisit it. Only ids and digests are grouped; payloads move once, by page_id, to where they are written.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digests = rows.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("sha"), F.octet_length("html").alias("size")).where(
        F.col("size") >= min_revisit_bytes)
    first = digests.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = stored(digests.join(first, ["sha", "size"]).where("page_id != first").select("page_id", "sha", "first").distinct(), "revisits")
    told = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).join(
        later.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first"), (F.col("page_id") == F.col("p")) & (F.col("sha") == F.col("s")), "left"
    ).select("page_id", "url", "html", "first")

    def run(batches):
        out = None
        for batch in batches:
            got: list[list] = [[] for _ in _CAPTURE]
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = _File(folder, "warc")
                payload = text.encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                offset, length = out.put(record(url, page_id, payload, digest, refers_to))
                for c, v in zip(got, (url_key(url), url, page_id, "response" if refers_to is None else "revisit", digest, out.name, offset, length)):
                    c.append(v)
                if out.at >= FILE_BYTES:
                    out.close()
                    out = None
            yield _rows(got, _CAPTURE)
        if out is not None:
            out.close()

    return stored(told.mapInArrow(run, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted blocks and directories; returns (first_key, last_key, file, directory, size) per index file, stored."""

    def run(batches):
        out, lines, directory, last = None, [], [], None

        def block():
            offset, length = out.put(zlib.compress("\n".join(lines).encode(), 6))
            directory.append(f"{lines[0].split(' ', 1)[0]} {offset} {length}")
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                out = out or _File(folder, "index")
                last = row["urlkey"]
                lines.append(f"{last} {json.dumps([row[k] for k in _FIELDS])}")
                if len(lines) >= block_lines:
                    block()
        if out is not None:
            if lines:
                block()
            first = directory[0].split(" ", 1)[0]
            at, size = out.put(zlib.compress("\n".join(directory).encode(), 6))
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [first], "last_key": [last], "file": [out.name], "directory": [at], "size": [size]})

    ordered = captures.repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    return stored(ordered.mapInArrow(run, "first_key string, last_key string, file string, directory long, size long"), "index")


def lookup(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The captures (CAPTURE) of the wanted URLs (column url), each URL once.

    Keys go to the index files that can hold them, the rows of one file in key order to as many tasks as there are keys for;
    a task reads the directory of the file and then only the blocks in which its keys fall.
    """
    files = sorted(tuple(r) for r in index.select("first_key", "last_key", "file", "directory", "size").collect())  # one row per index task
    shared = urls.sparkSession.sparkContext.broadcast(files)

    def place(batches):
        bounds = shared.value
        lasts = [b[1] for b in bounds]
        for batch in batches:
            keys, at = [], []
            for url in batch.column(0).to_pylist():
                key = url_key(url)
                k = bisect.bisect_left(lasts, key)
                while k < len(bounds) and bounds[k][0] <= key:
                    keys.append(key)
                    at.append(k)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int64())], ["key", "at"])

    def search(batches):
        reader, held, starts, spans, block, lines, heads = _Reader(), None, [], [], None, [], []
        for batch in batches:
            got: list[list] = [[] for _ in _CAPTURE]
            for key, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, _, name, offset, size = shared.value[at]
                if at != held:
                    entries = [e.split(" ") for e in zlib.decompress(reader.read(name, offset, size)).decode().split("\n")]
                    starts, spans, held, block = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries], at, None
                k = max(0, bisect.bisect_left(starts, key) - 1)
                while k < len(starts) and starts[k] <= key:
                    if k != block:
                        lines = zlib.decompress(reader.read(name, *spans[k])).decode().split("\n")
                        heads, block = [line.split(" ", 1)[0] for line in lines], k
                    i = bisect.bisect_left(heads, key)
                    while i < len(heads) and heads[i] == key:
                        for c, v in zip(got, (key, *json.loads(lines[i].split(" ", 1)[1]))):
                            c.append(v)
                        i += 1
                    k += 1
            yield _rows(got, _CAPTURE)
        reader.close()

    wanted = urls.select("url").mapInArrow(place, "key string, at long").distinct()
    return wanted.repartitionByRange("at", "key").sortWithinPartitions("at", "key").mapInArrow(search, CAPTURE)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def replay(captures: DataFrame) -> DataFrame:
    """Read the records of captures back by range reads and check them; RECORD per capture."""

    def run(batches):
        reader = _Reader()
        for batch in batches:
            found = [read_record(reader.read(*span)) for span in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pydict({
                "page_id": pa.array([r["page_id"] for r in found], pa.int64()), "payload_bytes": pa.array([r["payload_bytes"] for r in found], pa.int64()),
                "payload_digest": pa.array([r["digest"] for r in found], pa.string()), "record_type": pa.array([r["type"] for r in found], pa.string()),
                "refers_to": pa.array([r["refers_to"] for r in found], pa.int64()),
            })
        reader.close()

    span = F.floor(F.col("offset") / SPAN_BYTES)
    ordered = captures.select("file", "offset", "length").repartition("file", span).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORD)


def archive_and_replay(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive all pages, index them, look all their URLs up and read every record back."""
    folder = shared_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    index = write_index(write_archives(pages, folder, min_revisit_bytes), folder)
    return replay(lookup(pages.select("url"), index))
