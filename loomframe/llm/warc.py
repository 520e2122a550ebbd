"""Operator 2: WARC records in ZIP-packaged archives, written and read back by ranges.

Each archive is a ZIP with two stored members: WARC 1.1 records, each a gzip member of its own, and an index line for each
record. A reader finds the members from the central directory (ZIP64 too), reads the index, and then any record by its
range, without extraction. Of equal payloads that with the smallest id is the response, the others are revisits that refer
to it. Archives lie in the folder that all executors share. Each attempt of a task writes files of its own; the table of archives
lists those of the attempts that Spark took.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm import zipfile_ranges as zr
from loomframe.llm.common import drop, durable, new_path, read, small_batches

#: An archive is closed when its records have so many bytes; one is held in memory while it is written.
ARCHIVE_BYTES = 32 << 20
#: Bytes of ranges that are dealt together, and that one task reads, about.
READ_BYTES, TASK_BYTES = 4 << 20, 16 << 20
#: Bits of the table that tells which digests may be repeated, and of one of its rows: 16 MB in all.
REPEAT_BITS, ROW_BITS = 1 << 27, 1 << 15
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _packed(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def one_line(url: str | None) -> str:
    """A url as headers and index lines can hold it: without line ends."""
    return "".join(c for c in url or "" if c not in "\r\n")


def record(page_id, url: str | None, payload: bytes, refers_to, own_digest: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    target = one_line(url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{own_digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return _packed("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse(packed: bytes) -> dict:
    """Headers of a record, its HTTP headers and its payload; a response's digest is worked out from the payload."""
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    name = lambda x: int(x[10:-1]) if x[10:-1] else None
    out = {"page_id": name(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": int(inner["Content-Length"])}
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"] or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {out['page_id']}: the payload is not what was written")
        return out | {"payload_digest": digest(payload), "refers_to": None, "payload": payload}
    return out | {"payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": name(fields["WARC-Refers-To"]), "payload": None}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write_archives(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        part, number, done = TaskContext.get().partitionId(), 0, []
        held, lines, size = [], [], 0

        def close() -> None:
            nonlocal held, lines, size, number
            if not held:
                return
            # the name holds the attempt: a repeated task writes files of its own, and only the attempt that Spark takes lists them
            name = f"part-{part:06d}-{number:04d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as out:
                z = zr.Writer(out)
                z.add(RECORDS, *held)
                z.add(INDEX, *(line.encode() for line in lines))
                z.close()
            done.append((f"{folder}/{name}", len(lines)))
            held, lines, size, number = [], [], 0, number + 1

        for frame in frames:
            for page_id, url, payload, first, same in zip(frame["page_id"], frame["url"], frame["payload"], frame["first"], frame["same"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                refers = None if same else int(first)
                packed = record(page_id, url, payload, refers, digest(payload))
                lines.append(f"{one_line(url)} 20240101000000 {json.dumps({'offset': size, 'length': len(packed)})}\n")
                held.append(packed)
                size += len(packed)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pd.DataFrame(done, columns=["archive", "records"])

    return run


def may_repeat(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with may_repeat: true for every row whose sha is among repeated, and for few others as long as those are few against
    REPEAT_BITS. What is broadcast is a table of that many bits, however many digests there are."""
    place = F.pmod(F.xxhash64("sha"), F.lit(REPEAT_BITS))
    own = lambda df: df.withColumn("bits_row", F.shiftright(place, ROW_BITS.bit_length() - 1)).withColumn("bit", F.pmod(place, F.lit(ROW_BITS)))
    bits = own(repeated.select("sha")).groupBy("bits_row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1
    return own(rows).join(F.broadcast(bits), "bits_row", "left").withColumn("may_repeat", F.coalesce(found, F.lit(False))).drop("bits_row", "bit", "bits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes all rows of pages under folder; (archive, records) of the files. Payloads under least bytes are all responses.

    Only payloads that may be repeated are shuffled; the others are written by the tasks that read them. The tables of archives and of
    ranges stay in the shared folder with the archives: they are the caller's to delete.

    Null html is an empty payload. Rows without an id are responses that no revisit refers to; repeated rows of the smallest
    id are responses too.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    digests = own.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = durable(digests.filter("n > 1").drop("n"), "repeated")
    marked = may_repeat(own, repeated)
    # a payload of a third of all pages makes one large partition of this join, which AQE splits
    met = marked.filter("may_repeat").join(repeated, "sha", "left")
    same = F.col("page_id").isNull() | F.col("first").isNull() | (F.col("page_id") == F.col("first")) | (F.octet_length("payload") < least)
    columns = ("page_id", "url", "payload", "first")
    ready = marked.filter("not may_repeat").withColumn("first", F.lit(None).cast("long")).select(*columns, F.lit(True).alias("same"))
    ready = ready.unionByName(met.select(*columns, same.alias("same")))
    out = durable(ready.mapInPandas(_write_archives(folder), "archive string, records long"), "archives")
    drop(repeated)
    return out


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for archive in frame["archive"]:
            store, path = _store(archive)
            with store.open_input_file(path) as file:
                members = {m.name: m for m in zr.directory(file, file.size())}
                index = members[INDEX]
                records = zr.data_start(file, members[RECORDS])
                raw = zr._range(file, zr.data_start(file, index), index.size)
            found = [json.loads(line[line.rindex("{") :]) for line in raw.decode().split("\n") if line]
            at = [f["offset"] for f in found]
            yield pd.DataFrame({"archive": archive, "at": [records + x for x in at], "length": [f["length"] for f in found], "part": [x // READ_BYTES for x in at]})


def index(archives: DataFrame) -> DataFrame:
    """(archive, at, length, part): the range of each record, from the archives' own directories and indexes, as a table."""
    return durable(archives.select("archive").mapInPandas(_ranges, "archive string, at long, length long, part long"), "ranges")


def _read(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, part in frame.groupby("archive", sort=False):
                store, path = _store(archive)
                with store.open_input_file(path) as file:
                    found = (parse(zr._range(file, int(at), int(n))) for at, n in zip(part["at"], part["length"]))
                    out = pd.DataFrame([[r[k] for k in names] for r in found], columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_records(ranges: DataFrame, payload: bool = False) -> DataFrame:
    """The records of ranges, each read by itself; with their payloads if asked for (null for revisits). Tasks follow the bytes to
    read, as the rows of ranges are small."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    size = ranges.agg(F.sum("length").alias("n")).first().n or 0
    parts = max(ranges.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    return ranges.repartition(parts, "archive", "part").sortWithinPartitions("archive", "at").mapInPandas(_read(payload), schema)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html"), new_path(spark, "warc"))
    return read_records(index(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p
), f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d.h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR page_id IS NULL OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE CASE WHEN page_id IS NULL THEN NULL ELSE first END END AS refers_to
FROM d JOIN f ON d.h = f.h
"""
