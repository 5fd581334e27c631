"""WARC archives (a gzip member for each record) written and read as chunked record tables.

Digests decide which records revisit others, so they are formed before any
record is written.  Records go to archives as streams: the writer sends views
of a payload in pieces; the reader yields rows (record, chunk number, bytes)
with the running digest of all bytes so far, and neither holds a second copy
of a record or a record whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices

CHUNK = 64 << 10
#: Fixed: the profile of records whose payload equals another's; the address of a page without one; the name space of ids of records that others refer to.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NOWHERE = "urn:x-no-address:"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages`` (page_id, url, payload) with digest, bytes, and refers_to for the pages that revisit another.

    Of equal payloads of ``least`` bytes or more the smallest page_id is the
    response; the join is on page and digest, and only these two travel.
    """
    marked = pages.withColumns({"digest": F.sha2(F.col("payload"), 256), "bytes": F.octet_length("payload").cast("long")})
    marks = materialize(marked.select("page_id", "digest", "bytes"), "warc-marks")
    first = marks.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = marks.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    return marked.join(revisits, ["page_id", "digest"], "left")


def _open(path: str, mode: str):
    """A binary stream of a file in the shared folder, whatever store it is in."""
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    # as it is: by its name the stream would be compressed a second time
    return system.open_output_stream(local, compression=None) if mode == "w" else system.open_input_stream(local, compression=None)


def _header(fields: dict) -> bytes:
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n"


def _clean(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page: int, digest: str) -> str:
    """The id of a response that others refer to: known to all who know its page and payload."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}:{digest}')}>"


def _write(folder: str, chunk: int, date: str):
    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        # a name of its own for every attempt: only what a finished task reports is read
        path = f"{folder}/part-{t.partitionId():06d}-{t.taskAttemptId()}.warc.gz"
        out, n, named = None, 0, set()
        for b in slices(batches, 8 << 20, "payload"):
            payloads = b.column("payload")
            for k, r in enumerate(b.drop_columns(["payload"]).to_pylist()):
                out = out or _open(path, "w")
                # a view of the batch: the payload isn't copied
                payload, revisit = memoryview(payloads[k].as_buffer()), r["refers_to"] is not None
                own = record_id(r["page_id"], r["digest"])
                # a repeated row is a record of its own
                if revisit or own in named:
                    own = f"<urn:uuid:{uuid.uuid4()}>"
                named.add(own)
                head = {
                    "WARC-Type": "revisit" if revisit else "response",
                    "WARC-Record-ID": own,
                    "WARC-Date": date,
                    "WARC-Target-URI": _clean(r["url"]) or NOWHERE,
                    "WARC-Payload-Digest": f"sha256:{r['digest']}",
                    "WARC-Profile": PROFILE if revisit else None,
                    "WARC-Refers-To": record_id(r["refers_to"], r["digest"]) if revisit else None,
                    "X-Page-Id": r["page_id"],
                    "X-Refers-To-Page": r["refers_to"],
                    "X-Payload-Length": r["bytes"],
                    "Content-Type": "text/html; charset=utf-8",
                    "Content-Length": 0 if revisit else len(payload),
                }
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)  # a gzip member for each record
                out.write(gz.compress(_header(head)))
                for at in range(0, 0 if revisit else len(payload), chunk):
                    out.write(gz.compress(payload[at : at + chunk]))
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def write_warc(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Writes archives to the shared folder and returns the manifest (path, records)."""
    folder = f"{shared_dir(pages.sparkSession)}/mf-warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        import os

        os.makedirs(folder, exist_ok=True)
    else:
        from pyarrow import fs

        system, local = fs.FileSystem.from_uri(folder)
        system.create_dir(local, recursive=True)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return materialize(pages.mapInArrow(_write(folder, chunk, date), "path string, records long"), "warc-manifest")


class Inflated:
    """Reads a file of gzip members piece by piece."""

    def __init__(self, stream, piece: int = 64 << 10):
        self.stream, self.piece, self.raw, self.member = stream, piece, b"", None

    def read(self, n: int) -> bytes:
        """At most ``n`` bytes; none at the end."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    if self.member and not self.member.eof:
                        raise ValueError("archive ends within a record")
                    return b""
            self.member = self.member or zlib.decompressobj(31)
            out = self.member.decompress(self.raw, n)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if out:
                return out


def records(stream, chunk: int):
    """(headers, chunk number, bytes, digest so far, last) for every chunk of every record; one empty chunk for an empty payload."""
    held = b""

    def more() -> bool:
        nonlocal held
        got = stream.read(chunk)
        held += got
        return bool(got)

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends within a header")
                return
        lines = held[:end].decode().split("\r\n")
        held = held[end + 4 :]
        if lines[0] != "WARC/1.0":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        left, number, sha = int(headers["Content-Length"]), 0, hashlib.sha256()
        while True:
            while len(held) < min(left, chunk):
                if not more():
                    raise ValueError("archive ends within a payload")
            piece, held = held[: min(left, chunk)], held[min(left, chunk) :]
            left -= len(piece)
            sha.update(piece)
            yield headers, number, piece, sha.copy().hexdigest(), not left
            number += 1
            if not left:
                break
        while len(held) < 4:
            if not more():
                raise ValueError("archive ends within a record's end")
        if held[:4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        held = held[4:]


CHUNKS = "archive string, record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, chunk int, last boolean, digest_so_far string, data binary"


def _read(chunk: int):
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                with _open(path, "r") as stream:
                    for h, number, piece, sha, last in records(Inflated(stream), chunk):
                        page, ref, uri = h.get("X-Page-Id"), h.get("X-Refers-To-Page"), h["WARC-Target-URI"]
                        rows.append((path, h["WARC-Record-ID"], page and int(page), None if uri == NOWHERE else uri, h["WARC-Type"], ref and int(ref), h["WARC-Payload-Digest"][7:], int(h["X-Payload-Length"]), number, last, sha, piece))
                        size += len(piece) + 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_warc(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives named in ``manifest``: a row for each chunk of each record."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInArrow(_read(chunk), CHUNKS)


def warc_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a row for each record read back.

    Of records that were stored in full, size and digest are those of the
    bytes read; a revisit's are those its header carries.

    A null payload is empty; null ids and urls are read back as null, and a
    null id neither revisits nor is revisited; rows that repeat an id and a
    payload have the same role; line ends in a url are percent-encoded; other
    columns are not stored; an empty table writes no archive.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    chunks = read_warc(write_warc(roles(rows), chunk), chunk)
    seen = chunks.select("archive", "record_id", "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "chunk", "digest_so_far", F.octet_length("data").cast("long").alias("n"))
    per = seen.groupBy("archive", "record_id").agg(
        F.first("page_id").alias("page_id"), F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"),
        F.first("payload_digest").alias("told"), F.first("payload_bytes").alias("told_bytes"), F.sum("n").alias("n"), F.max_by("digest_so_far", "chunk").alias("sha"),
    )
    full = F.col("record_type") == "response"
    return per.select("page_id", F.when(full, F.col("n")).otherwise(F.col("told_bytes")).alias("payload_bytes"), F.when(full, F.col("sha")).otherwise(F.col("told")).alias("payload_digest"), "record_type", "refers_to")
