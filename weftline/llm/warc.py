"""WARC archives: writing, and normalising monolithic gzip files to one member a record.

Many writers compress a whole archive as one gzip stream, which allows no random access. The
normaliser inflates such a file once, as a stream, writes every record as a gzip member of its
own and a sidecar index with each record's offset and length; records are then read singly.
Files are named by attempt and listed in a table that Spark commits, so a retried or
speculative task leaves unlisted files at worst. Paths are opened through pyarrow's
filesystems, so archives may be in any store it knows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import scratch

#: Payloads below this many bytes are never stored as revisits.
REVISIT_BYTES = 100
LEVEL = 4  # of gzip
CHUNK = 1 << 18
#: Mean bytes of payload an archive holds.
ARCHIVE_BYTES = 24 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def opened(path: str, mode: str) -> BinaryIO:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_stream(name, compression=None) if mode == "r" else store.open_output_stream(name, compression=None) if mode == "w" else store.open_input_file(name)


def uri(path: str) -> str:
    """Spark prints file:/x for file:///x."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def _clean(value: str) -> str:
    """Header values hold no control characters."""
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers but no payload. A page without an id gets a record id of another kind."""
    urn = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"{URN}{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or urn)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def inflate(stream: BinaryIO, size: int = CHUNK) -> Iterator[bytes]:
    """The contents of all gzip members of a stream, in pieces."""
    box = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            if out := box.decompress(data, size):
                yield out
            data = box.unconsumed_tail
            if box.eof:
                data, box = box.unused_data, zlib.decompressobj(31)
    if out := box.flush():
        yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, whole, one at a time."""
    buffer = bytearray()
    ended = False

    def fill(until: int) -> None:
        nonlocal ended
        while len(buffer) < until and not ended:
            piece = next(pieces, None)
            ended = piece is None
            buffer.extend(piece or b"")

    while True:
        at = buffer.find(b"\r\n\r\n")
        while at < 0 and not ended:
            fill(len(buffer) + 1)
            at = buffer.find(b"\r\n\r\n")
        if at < 0:
            if buffer.strip():
                raise ValueError("an archive ends inside a record's header")
            return
        head = header_of(bytes(buffer[: at + 4]))
        end = at + 4 + int(head["content-length"]) + 4
        fill(end)
        if len(buffer) < end:
            raise ValueError("an archive ends inside a record")
        yield bytes(buffer[:end])
        del buffer[:end]


def header_of(record: bytes) -> dict[str, str]:
    lines = record[: record.index(b"\r\n\r\n")].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(record: bytes) -> dict:
    """What a record says, its payload's bytes and digest computed anew where it holds the payload."""
    head = header_of(record)
    block = record[record.index(b"\r\n\r\n") + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x.strip("<>").removeprefix(URN)) if x.startswith("<" + URN) else None
    response = head["warc-type"] == "response"
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {
        "page_id": number(head["warc-record-id"]), "payload_bytes": len(payload) if response else stated,
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else head["warc-payload-digest"].removeprefix("sha256:"),
        "record_type": head["warc-type"], "refers_to": None if response else number(head["warc-refers-to"]), "url": head["warc-target-uri"],
    }


def write_archives(pages: DataFrame, out: str, level: int = LEVEL) -> DataFrame:
    """One monolithic .warc.gz for each partition of pages (page_id, url, html, digest, refers_to): (path, records)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, n, file, gz = f"{out}/{uuid.uuid4().hex}.warc.gz", 0, None, zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, html, digest, ref in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"], strict=True):
                file = file or opened(path, "w")
                file.write(gz.compress(build_record(None if pd.isna(page_id) else int(page_id), url, html.encode("utf-8"), digest, None if pd.isna(ref) else int(ref))))
                n += 1
        if file is not None:
            file.write(gz.flush())
            file.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    return pages.mapInPandas(write, "path string, records long")


def normalise_archives(files: DataFrame, out: str, level: int = LEVEL) -> DataFrame:
    """Rewrites the archives named in files.path: (path, index, records) of the files with a member for each record.

    The index is JSON lines of offset, length and record id, in the file's order.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                name = f"{out}/{uuid.uuid4().hex}"
                with opened(path, "r") as source, opened(f"{name}.warc.gz", "w") as file, opened(f"{name}.index.jsonl", "w") as index:
                    at = n = 0
                    for record in split_records(inflate(source)):
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = gz.compress(record) + gz.flush()
                        file.write(member)
                        index.write((json.dumps({"offset": at, "length": len(member), "id": header_of(record)["warc-record-id"]}) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pd.DataFrame({"path": [f"{name}.warc.gz"], "index": [f"{name}.index.jsonl"], "records": [n]})

    return files.select("path").mapInPandas(rewrite, "path string, index string, records long")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of normalised archives, each read alone at its offset in the index."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, index in zip(batch["path"], batch["index"], strict=True):
                with opened(index, "r") as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with opened(path, "rw") as f:
                    for e in entries:
                        f.seek(e["offset"])
                        rows.append(parse_record(zlib.decompress(f.read(e["length"]), 31)) | {"offset": e["offset"], "length": e["length"]})
                        if len(rows) == 2000:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    return files.select("path", "index").mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, offset long, length long")


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES, parts: int = 8) -> DataFrame:
    """pages with html (null: empty), digest and refers_to: the smallest page_id of those with an equal payload.

    Only digests that occur twice are joined, their counts being combined before any shuffle.
    The rows come hashed by page_id into `parts` partitions; payloads move once. Rows without
    a page_id are placed by their digest and url instead.
    """
    html, digest = F.coalesce("html", F.lit("")).cast("binary"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    place = F.coalesce(F.col("page_id").cast("long"), F.xxhash64(digest, F.pmod(F.xxhash64("url"), F.lit(64))))
    keyed = pages.select(place.alias("_place"), "page_id", "url", "html").repartition(parts, F.col("_place"))
    keyed = keyed.select("_place", "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    small = pages.select(place.alias("_id"), "page_id", digest.alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= least)
    groups = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    revisits = small.join(groups, "digest").where("page_id is null or page_id > first").select("_id", F.struct("digest", "first").alias("_r"))
    revisits = revisits.repartition(parts, F.col("_id")).groupBy("_id").agg(F.map_from_entries(F.collect_set("_r")).alias("_r"))  # a row an id, so payloads keep their place
    rows = keyed.join(revisits, keyed["_place"] == revisits["_id"], "left")
    first = F.try_element_at("_r", F.col("digest"))
    return rows.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > first), first)).drop("_id", "_r", "_place")


def round_trip(spark: SparkSession, pages: DataFrame, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages to archives, normalises and reads them: a row for each page.

    Null html is an empty payload. Rows with a null page_id get a record id that names no page:
    they revisit others, but none revisits them. Of rows that repeat a page_id each gets its
    record; equal payloads with the smallest id are all responses. Pages may have any other columns.
    """
    out = uri(scratch(spark, "warc"))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(1, -(-total // archive_bytes), min(2 * spark.sparkContext.defaultParallelism, total >> 20))
    rows = with_revisits(pages, parts=parts)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(conf).mkdirs(path)
    write_archives(rows, out, level).write.parquet(f"{out}/written")
    written = spark.read.parquet(f"{out}/written")
    n = max(1, written.count())
    normalise_archives(written.repartition(n), out, level).write.parquet(f"{out}/normalised")
    done = spark.read.parquet(f"{out}/normalised")
    return read_archives(done.repartition(n))
