"""Web archives written with an index, and read back by coalesced byte ranges.

Every task writes one archive file of compressed records in the shared folder and returns
an index row for each record: file, offset, length, URL and digest. Only rows of tasks
that Spark commits become part of the index, so the file of a lost or repeated task is
never read. Reading starts from selected index rows, sorts them by place, joins ranges
that lie close together into one read, and checks each payload against its digest.

Equal payloads are stored once: the record of the largest page key is the response, the
others are revisits that refer to it.

Defined cases: a null payload is an empty one; a null URL leaves the header out; of equal
payloads without any page key all are responses; repeated rows of the largest key are all
responses; a null key is a revisit if another row of that payload has a key; an empty
table gives an empty index and result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger import session
from skyledger.llm.common import slices, text_of, written

#: Fixed values of the archive format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
RANGE_GAP = 64 << 10  # ranges with at most this many bytes between them are read at once
RANGE_MOST = 8 << 20  # and a read ends after this many bytes, unless one record is longer
READ_BYTES, READ_RECORDS = 64 << 20, 20_000  # a task reads about this much of the archives, whichever comes first
SPREAD_GROUPS = 1_000  # at most so many payloads are common enough to be sent to every task


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight digits for every ten hexadecimal ones."""
    digits = F.sha1(payload)
    parts = (F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_responses(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Key, URL, payload and digest of every page, and the page its payload is kept with (null: its own).

    Only digests that occur twice are joined. A payload with more than a thousandth of the
    repeated pages is one of fewer than ``SPREAD_GROUPS``; these are sent to every task, and their
    pages are spread over the tasks of the join instead of meeting in one.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), text_of(payload).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    repeated = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated, "repeated-payloads")
    common = F.col("n") > (repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n // SPREAD_GROUPS)
    often = repeated.where(common).select("digest", F.col("kept").alias("kept_often"), F.lit(True).alias("often"))
    rows = rows.join(F.broadcast(often), "digest", "left")
    apart = F.when(F.col("often"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("digest"))
    seldom = repeated.where(~common).select(F.col("digest").alias("place"), "kept")
    rows = rows.withColumn("place", apart).join(seldom, "place", "left").withColumn("kept", F.coalesce("kept_often", "kept"))
    own = F.col("kept").isNull() | F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.select("page_id", "url", "payload", "digest", F.when(~own, F.col("kept")).alias("refers_to"))


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if url is not None:  # a header is one line
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of Spark's default file system where it names none: tasks must not take it for their own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every row of ``with_responses`` as a record below ``folder``; returns the written index."""
    folder = qualified(rows.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in slices(batches):
                index = []
                for row in batch.to_pylist():
                    if out is None:
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/{name}", compression=None)  # records are compressed one by one
                    record = _record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)
                    out.write(record)
                    index.append((name, offset, len(record), row["url"], row["digest"], row["page_id"], "response" if row["refers_to"] is None else "revisit"))
                    offset += len(record)
                names = [f.strip().split(" ")[0] for f in INDEX.split(",")]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in index], kinds[i]) for i in range(len(names))], names)
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(write, INDEX), "archive-index")


def _parsed(data: bytes) -> dict:
    """One record: its page, payload and the identity of what it refers to."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b" ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": full,
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page_of(fields["WARC-Refers-To"]) if revisit else None}


def coalesced(places: Iterator[tuple[str, int, int]], gap: int = RANGE_GAP, most: int = RANGE_MOST) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) joined into reads: file, offset, length and the places inside."""
    file, begin, end, inside = None, 0, 0, []
    for name, offset, length in places:
        if inside and (name != file or offset - end > gap or offset + length - begin > most):
            yield file, begin, end - begin, inside
            inside = []
        if not inside:
            file, begin, end = name, offset, offset
        inside.append((offset - begin, length))
        end = max(end, offset + length)
    if inside:
        yield file, begin, end - begin, inside


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, read in sorted, coalesced byte ranges, by as many tasks as their bytes ask for."""
    folder = qualified(index.sparkSession, folder)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        places = ((r["file"], r["offset"], r["length"]) for batch in slices(batches) for r in batch.to_pylist())
        opened, source = None, None
        for name, begin, length, inside in coalesced(places):
            if name != opened:
                opened, source = name, system.open_input_file(f"{root}/{name}")
            data = source.read_at(length, begin)
            found = [_parsed(data[at:at + n]) for at, n in inside]
            if not payloads:
                for record in found:
                    record["payload"] = None
            yield pa.RecordBatch.from_pylist(found, schema)

    selected = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("records")).first()
    tasks = max(1, -(-selected.bytes // READ_BYTES), -(-selected.records // READ_RECORDS))
    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, RECORD)


def archive_folder(spark: SparkSession) -> str:
    return session.new_path(spark, "archives")
