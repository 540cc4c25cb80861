"""Legacy archives: ARC 1 and 2 files to WARC, with revisit records for repeated payloads.

An ARC file begins with a version block (`filedesc://`), whose second line names the fields of
every later header line: five in version 1, ten in version 2.  A record is one header line, the
declared number of bytes and a line end.  The converter reads by declared length only and makes

- warcinfo for the version block, response for HTTP records (revisit where the payload is kept
  elsewhere), resource for anything else,
- record ids as name-based UUIDs of URL, date, page and payload digest, so that a record can be
  referred to from another file before or after it is written,
- WARC-Date from the 14-digit date, payload and block digests as base32 SHA-1.

`archive_pages` decides responses and revisits with one grouping by payload digest, packs its rows
into ARC files in tasks, converts them, and writes WARC files of bounded size to the shared folder.
A task's files carry the attempt in their names, and only files that a finished task reports are
read again, so lost or repeated tasks leave no double records.

Null html: an empty payload.  Null page_id or url: written without it; a null page_id is smaller than
any other.  Rows that repeat both page_id and payload are all responses if theirs is the largest page_id.
Empty table: no file, empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import new_path, stored

FILE_BYTES, READ_TASKS = 16 << 20, 10_000
DATE = "20010203040506"
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(text: str | None) -> str:
    """A header field: no white space, and - when there is nothing."""
    safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in text or "")
    return safe or "-"


def record_id(url: str, date: str, page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page} {digest}')}>"


# --- ARC ---------------------------------------------------------------------------------------

def arc_version_block(name: str, version: int, date: str = DATE) -> bytes:
    body = f"{version} 0 evenkeel\n{FIELDS[version]}\n".encode()
    named = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date,
             "Content-type": "text/plain", "Result-code": "200", "Filename": name,
             "Offset": "0", "Archive-length": str(len(body))}
    return _arc_line(version, named) + body + b"\n"


def _arc_line(version: int, named: dict[str, str]) -> bytes:
    return " ".join(named.get(f, "-") for f in FIELDS[version].split()).encode() + b"\n"


def arc_record(
    version: int, name: str, offset: int, url: str | None, page: str | None, payload: bytes,
    date: str = DATE,
) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    head += f"X-Page-Id: {page}\r\n" if page is not None else ""
    block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    named = {"URL": _field(url), "IP-address": "0.0.0.0", "Archive-date": date,
             "Content-type": "text/html", "Result-code": "200", "Checksum": base32_sha1(payload),
             "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return _arc_line(version, named) + block + b"\n"


def read_arc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, the version block first."""
    names: list[str] | None = None
    while True:
        line = source.readline()
        if not line:
            return
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if names is None:
            # the version block's own line: its length tells the version before the names do
            names = FIELDS[2 if len(parts) >= 10 else 1].split()
            length = int(parts[-1])
            block = source.read(length)
            declared = block.split(b"\n")[1].decode().split() if block.count(b"\n") > 1 else names
            header = dict(zip(names, parts))
            names = declared
            yield header, block
            continue
        # a content type may hold blanks: the fields after it are counted from the end
        at = names.index("Content-type") if "Content-type" in names else 3
        after = len(names) - at - 1
        fixed = parts[:at] + [" ".join(parts[at : len(parts) - after])] + parts[len(parts) - after :]
        header = dict(zip(names, fixed))
        block = source.read(int(header["Archive-length"]))
        if len(block) < int(header["Archive-length"]):
            raise ValueError(f"cut off in the record of {header['URL']}")
        yield header, block


# --- WARC --------------------------------------------------------------------------------------

def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _iso(date: str) -> str:
    d = (date + "00000101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, head + b"\r\n\r\n", payload


def convert_arc(source: BinaryIO, refers: dict | None = None) -> Iterator[bytes]:
    """WARC records (gzip members) of an ARC file.  refers: place of a record in the file (the version
    block is 0) to (page id, URL) of the record that keeps the same payload."""
    refers = refers or {}
    for place, (header, block) in enumerate(read_arc(source)):
        url, date = header["URL"], header["Archive-date"]
        if url.startswith("filedesc://"):
            name = url.removeprefix("filedesc://")
            yield _warc(
                [("WARC-Type", "warcinfo"), ("WARC-Filename", name), ("WARC-Date", _iso(date)),
                 ("WARC-Record-ID", record_id(url, date, "", base32_sha1(block))),
                 ("Content-Type", "application/warc-fields")],
                f"software: evenkeel\r\nformat: WARC File Format 1.0\r\nisPartOf: {name}\r\n".encode(),
            )
            continue
        if not block.startswith(b"HTTP/"):
            digest = base32_sha1(block)
            yield _warc(
                [("WARC-Type", "resource"), ("WARC-Target-URI", url), ("WARC-Date", _iso(date)),
                 ("WARC-Record-ID", record_id(url, date, "", digest)),
                 ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", header["Content-type"])],
                block,
            )
            continue
        fields, head, payload = http_parts(block)
        page, digest = fields.get("x-page-id", ""), base32_sha1(payload)
        kept = refers.get(place)
        body = head if kept else block
        more = []
        if kept:
            more = [("WARC-Refers-To", record_id(kept[1], date, kept[0], digest)),
                    ("WARC-Refers-To-Target-URI", kept[1]), ("WARC-Profile", REVISIT)]
        yield _warc(
            [("WARC-Type", "revisit" if kept else "response"), ("WARC-Target-URI", url),
             ("WARC-Date", _iso(date)), ("WARC-Record-ID", record_id(url, date, page, digest)),
             ("WARC-IP-Address", header.get("IP-address", "0.0.0.0")),
             ("WARC-Payload-Digest", f"sha1:{digest}"),
             ("WARC-Block-Digest", f"sha1:{base32_sha1(body)}"), *more,
             ("Content-Type", "application/http; msgtype=response")],
            body,
        )


def read_warc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.GzipFile(fileobj=source) as plain:
        while line := plain.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields = {}
            while (line := plain.readline()).strip():
                k, _, v = line.decode("utf-8").partition(":")
                fields[k.strip()] = v.strip()
            yield fields, plain.read(int(fields["Content-Length"]))


# --- on Spark ----------------------------------------------------------------------------------

def decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """page (the row), and keeper and keeper_url where another row keeps the payload."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").alias("page"), "url", text.alias("html"),
        F.sha1(F.encode(text, "UTF-8")).alias("digest"),
    )
    best = F.max_by("url", F.coalesce("page", F.lit(-(1 << 63)).cast("long")))
    keepers = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(
        F.max("page").alias("keeper"), best.alias("keeper_url")
    )
    joined = rows.join(keepers, "digest", "left")
    other = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page"))
    return joined.select(
        "page", "url", "html",
        F.when(other, F.col("keeper")).alias("keeper"),
        F.when(other, F.col("keeper_url")).alias("keeper_url"),
    )


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made = 0

        def close(arc: io.BytesIO, refers: dict, records: int) -> pa.RecordBatch:
            nonlocal made
            name = f"part-{task.partitionId():06d}-{made:05d}-{task.taskAttemptId()}.warc.gz"
            made += 1
            arc.seek(0)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for member in convert_arc(arc, refers):
                    out.write(member)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})

        def begin():
            version = 1 + made % 2
            name = f"part-{task.partitionId():06d}-{made:05d}.arc"
            arc = io.BytesIO()
            arc.write(arc_version_block(name, version))
            return arc, {}, 0, version, name

        arc, refers, records, version, name = begin()
        for batch in batches:
            parts = (batch.slice(i, 256) for i in range(0, len(batch), 256))
            rows = (r for part in parts for r in zip(*(c.to_pylist() for c in part.columns)))
            for page, url, html, keeper, keeper_url in rows:
                key = None if page is None else str(page)
                arc.write(arc_record(version, name, arc.tell(), url, key, html.encode("utf-8", "replace")))
                records += 1
                if keeper is not None:
                    refers[records] = (str(keeper), _field(keeper_url))
                if arc.tell() >= file_bytes:
                    yield close(arc, refers, records)
                    arc, refers, records, version, name = begin()
        if records:
            yield close(arc, refers, records)

    return run


def archive_pages(pages: DataFrame, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as WARC files; path and records of each file."""
    folder = new_path(pages.sparkSession, "warc")
    pafs.FileSystem.from_uri(folder)  # a store that pyarrow does not know is refused here
    rows = decisions(pages, least)
    return stored(rows.mapInArrow(_writer(folder, file_bytes), "path string, records long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names
        )

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = pafs.FileSystem.from_uri(path)
            rows = []
            with store.open_input_stream(at, compression=None) as source:
                for fields, block in read_warc(source):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = http_parts(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} is damaged")
                    page = http.get("x-page-id")
                    rows.append(
                        (None if page is None else int(page), int(http["content-length"]), digest,
                         fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"))
                    )
                    if len(rows) >= 5000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records; a reference is
    resolved through the record id of the response that it names."""
    files = manifest.select("path").repartition(min(max(1, manifest.count()), READ_TASKS))
    records = stored(
        files.mapInArrow(
            _reader,
            "page_id long, payload_bytes long, payload_digest string, record_type string, "
            "record_id string, refers string",
        ),
        "records",
    )
    kept = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")
    ).distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = records.filter("record_type = 'revisit'").join(kept, "refers", "left")
    whole = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return whole.select(*columns).union(revisits.select(*columns))
