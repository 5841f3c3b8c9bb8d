"""WARC archives with an index (operator 9).

Every task writes the records of its rows, one gzip member each, to an archive
of its own below a shared folder and returns the index: archive, offset,
length, URL and digest per record. The index is stored first; readers select
records there, sort them by archive and offset, and fetch them in byte ranges
that join neighbours. A task that is run again writes a new archive, and only
the one that the stored index names is ever read.

Equal payloads (by SHA-1 and length) of at least ``revisit_bytes`` bytes are
stored once, with the row of the largest id; the others become ``revisit``
records. Defined results: null html is an empty payload; a null URL leaves the
header out; control characters in URLs are percent-encoded; null ids count as
the smallest, and rows of one id and payload get a record each, of one type.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm.common import map_batches, materialise
from wearline.session import shared_path, ship_package

#: Ranges that are at most this far apart are read together, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

INDEX = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("record_type", T.StringType()),
])

RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that random access works on, and the folder's path in it."""
    if re.match(r"file:/|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record. The HTTP header of a revisit still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!\"#$%&'()*+,/:;<=>?@[\\]^`{|}~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> list:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    ident = lambda name: None if (x := fields[name][len("<urn:page:"):-1]) == "null" else int(x)
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "revisit":
        return [ident("WARC-Record-ID"), fields.get("WARC-Target-URI"), n, digest, kind, ident("WARC-Refers-To"), None]
    if len(payload) != n or _digest(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return [ident("WARC-Record-ID"), fields.get("WARC-Target-URI"), n, digest, kind, None, payload]


def _base32(hex_digest):
    """Base32 of 40 hex digits in native functions: 5 hex digits are 4 of base 32."""
    five = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*five)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row; the stored index (columns of ``INDEX``)."""
    spark = pages.sparkSession
    ship_package(spark)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", _base32(F.sha1("payload")))
    # Only ids and digests are grouped; payloads move once, spread by id.
    small = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    last = small.filter(F.col("n") >= revisit_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("last"))
    revisits = (small.join(last, ["digest", "n"]).filter(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()))
                .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("last").alias("refers_to"))
                .distinct())
    full = rows.join(revisits, rows.page_id.eqNullSafe(revisits.r_id) & (rows.digest == revisits.r_digest), "left")
    folder = shared_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        try:
            for b in batches:
                if b.num_rows == 0:
                    continue
                if out is None:
                    store, path = _open_folder(folder)
                    store.create_dir(path, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                index = []
                for page_id, url, data, digest, refers_to in zip(*(b.column(c).to_pylist() for c in (
                        "page_id", "url", "payload", "digest", "refers_to"))):
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(_record(page_id, url, data, digest, refers_to, date)) + pack.flush()
                    out.write(member)
                    index.append((f"{folder}/{name}", at, len(member), url, digest, page_id,
                                  "response" if refers_to is None else "revisit"))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index)], names=INDEX.names).cast(_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    written = full.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX)
    return materialise(written, "warc-index")


_INDEX_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                          ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])


def _ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of sorted records that one read fetches (first, end)."""
    first = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP_BYTES \
                or offsets[i] + lengths[i] - offsets[first] > READ_BYTES:
            yield first, i
            first = i


def read_warc(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows ``selected``, read from the archives
    (columns of ``RECORD``; ``payload`` is null in revisits, and everywhere
    unless ``payloads``). Broken records and wrong digests raise an error."""
    where = (selected.select("archive", "offset", "length").repartitionByRange("archive", "offset")
             .sortWithinPartitions("archive", "offset"))

    def run(b: pa.RecordBatch) -> Iterator[list]:
        archives, offsets, lengths = (b.column(i).to_pylist() for i in range(3))
        first = 0
        for end in range(1, len(archives) + 1):
            if end < len(archives) and archives[end] == archives[first]:
                continue
            folder, name = archives[first].rsplit("/", 1)
            store, path = _open_folder(folder)
            with store.open_input_file(f"{path}/{name}") as f:
                for a, z in _ranges(offsets[first:end], lengths[first:end]):
                    begin = offsets[first + a]
                    size = offsets[first + z - 1] + lengths[first + z - 1] - begin
                    data = f.read_at(size, begin)
                    got = []
                    for o, n in zip(offsets[first + a:first + z], lengths[first + a:first + z]):
                        got.append(_parse(zlib.decompress(data[o - begin:o - begin + n], 31)))
                        if not payloads:
                            got[-1][-1] = None
                    yield list(zip(*got))
            first = end

    return map_batches(where, RECORD, run)
