"""WARC archives of web pages, written in shards and read back.

Records are sorted by page over ranges whose bounds come from the pages: from those whose
hash falls into a share. A task writes a range into files that are closed at a compressed
size; each file is written under a temporary name and then renamed, and a manifest, written
last and as a whole, names the files that count. Ranges, file names, record ids, headers
and digests follow from the pages alone, so a task that runs again, a second attempt and a
second writing, however partitioned, give the same files.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growthgrain.operators.hot import join_spread

#: Payloads below this are stored each time.
SMALLEST_REVISIT = 1000
#: A file ends with the record that brings it to this many compressed bytes.
FILE_BYTES = 64 << 20
#: Payload bytes for each range of pages; few pages make up to so many smaller ranges.
RANGE_BYTES, LEAST_RANGE_BYTES, SMALL_RANGES = 256 << 20, 2 << 20, 64
#: Pages that the bounds of a range are taken from.
SAMPLED = 32
#: Groups of equal payloads that are sent to all executors; more are joined by shuffle.
FEW_GROUPS = 100_000
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = "file string, records bigint, bytes bigint, sha1 string, first_page bigint, last_page bigint"
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)


def _filesystem(folder: str):
    """The store and the path in it of a folder given as a URI or a local path."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(text: str) -> str:
    """Text that stays in one header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or c == "%" else c for c in text)


def _unfield(text: str) -> str:
    from urllib.parse import unquote

    return unquote(text)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", len(block))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return _gzip(head.encode() + b"\r\n" + block + b"\r\n\r\n")


def page_record(page: dict) -> bytes:
    """The compressed record of a page: a response, or a revisit without the payload."""
    payload = page["payload"]
    head = (HTTP % len(payload)).encode()
    page_id, refers_to = page["page_id"], page["refers_to"]
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if page["url"] is None else _field(page["url"])),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, head + payload if refers_to is None else head)


def _info_record(file: str) -> bytes:
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", file),
        ("Content-Type", "application/warc-fields"),
    ]
    return _record(fields, b"format: WARC File Format 1.1\r\n")


class _File:
    """A file under a temporary name, until it is closed."""

    def __init__(self, folder: str, name: str):
        self.store, self.folder = _filesystem(folder)
        self.name = name
        self.temporary = f"{self.folder}/_temporary-{name}-{uuid.uuid4().hex}"
        self.store.create_dir(self.folder, recursive=True)
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.digest, self.bytes, self.pages = hashlib.sha1(), 0, []
        self.write(_info_record(name))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def add(self, page: dict) -> None:
        self.write(page_record(page))
        ends = [self.pages[0][0] if self.pages else page["page_id"], page["page_id"]]
        self.pages = [ends, self.pages[1] + 1 if self.pages else 1]

    def _there(self, final: str) -> bool:
        """Whether the file has been written, with the same bytes."""
        from pyarrow import fs

        found = self.store.get_file_info(final)
        if found.type == fs.FileType.NotFound or found.size != self.bytes:
            return False
        digest = hashlib.sha1()
        with self.store.open_input_stream(final, compression=None) as stream:
            while data := stream.read(1 << 20):
                digest.update(data)
        return digest.digest() == self.digest.digest()

    def close(self) -> dict:
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self._there(final):  # by another attempt, whose result may be committed already
            self.store.delete_file(self.temporary)
        else:
            self.store.move(self.temporary, final)
        (first, last), records = self.pages
        return {
            "file": self.name,
            "records": records,
            "bytes": self.bytes,
            "sha1": self.digest.hexdigest(),
            "first_page": first,
            "last_page": last,
        }


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array([row[name] for row in rows], kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _writer(folder: str, file_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, number, closed = None, -1, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if file is not None and (page["range"] != at or file.bytes >= file_bytes):
                    closed.append(file.close())
                    file = None
                if file is None:
                    number = number + 1 if page["range"] == at else 0
                    at = page["range"]
                    file = _File(folder, f"pages-{at:06d}-{number:04d}.warc.gz")
                file.add(page)
        if file is not None:
            closed.append(file.close())
        yield _rows(closed, MANIFEST)

    return write


def _range_of(bounds: list[tuple[int, int]]):
    """A function of the page and its place among rows of that page: how many bounds are
    not above them. A missing page is below all others."""
    lowest = np.iinfo(np.int64).min
    pages = np.array([lowest if p is None else p for p, _ in bounds], np.int64)
    places = np.array([x for _, x in bounds], np.int64)

    @F.pandas_udf("int")
    def find(page: pd.Series, place: pd.Series) -> pd.Series:
        page, place = page.to_numpy(np.int64), place.to_numpy(np.int64)
        first, last = np.searchsorted(pages, page, "left"), np.searchsorted(pages, page, "right")
        for i in np.flatnonzero(first < last):
            first[i] += np.searchsorted(places[first[i] : last[i]], place[i], "right")
        return pd.Series(first.astype(np.int32))

    def of(page: Column, place: Column) -> Column:
        return find(F.coalesce(page, F.lit(lowest)), place)

    return of


def _bounds(rows: DataFrame, n: int, ranges: int) -> list[tuple[int, int]]:
    """Where ranges of pages begin. What reaches the driver are some ``SAMPLED`` different
    pages for each range, whichever tasks the pages are in."""
    share = F.pmod(F.xxhash64("page_id", "place", F.lit(1)), F.lit(max(1, n // (ranges * SAMPLED))))
    sample = rows.where(share == 0).select("page_id", "place").distinct().toArrow().to_pylist()
    keys = sorted(((r["page_id"], r["place"]) for r in sample), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if len(keys) >= ranges else []


def with_revisits(pages: DataFrame, most: int = FEW_GROUPS) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and ``refers_to``, the page that a revisit repeats."""
    rows = pages.select(
        pages.page_id.cast("bigint").alias("page_id"),
        pages.url.cast("string").alias("url"),
        F.coalesce(pages.html, F.lit("")).cast("binary").alias("payload"),
    ).withColumn(
        "digest", F.when(F.length("payload") >= SMALLEST_REVISIT, F.unhex(F.sha1("payload")))
    )
    groups = (
        rows.where("digest is not null")
        .groupBy(F.col("digest").alias("group"))
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
        .checkpoint()
    )
    again = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    if groups.limit(most + 1).count() <= most:
        joined = rows.join(F.broadcast(groups), F.col("digest") == F.col("group"), "left")
    else:  # frequent payloads, and those too small to have a digest, go to many tasks
        keyed = rows.withColumn("key", F.coalesce(F.hex("digest"), F.concat(F.lit("-"), F.xxhash64("page_id", "payload").cast("string"))))
        joined = join_spread(keyed, groups.withColumn("key", F.hex("group")), ["first_id"], "key")
    return joined.select(
        "page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` as compressed WARC files in ``folder``, with a manifest.

    Of pages with equal payloads of at least 1000 bytes, that with the largest
    ``page_id`` is a response and the others are revisits; a null ``page_id`` is smaller
    than all others, and rows that share the largest are all responses. A null ``html``
    is an empty payload, a null ``url`` is left out. An empty table gives a manifest
    without files. A payload of any length is one record. Further columns are not written.
    Rows of one page are told apart by a hash of payload and url; rows equal in all three
    are in one range.
    """
    place = F.xxhash64("payload", "url")
    rows = with_revisits(pages).withColumn("place", place)
    total, n = pages.agg(F.sum(F.octet_length(pages.html)), F.count("*")).first()
    total = total or 0
    ranges = max(-(-total // RANGE_BYTES), min(SMALL_RANGES, -(-total // LEAST_RANGE_BYTES)), 1)
    read = pages.select(
        pages.page_id.cast("bigint").alias("page_id"),
        F.coalesce(pages.html, F.lit("")).cast("binary").alias("payload"),
        pages.url.cast("string").alias("url"),
    )
    bounds = _bounds(read.withColumn("place", place), n, ranges)
    ranged = rows.withColumn("range", _range_of(bounds)(F.col("page_id"), F.col("place")))
    ordered = ranged.repartition(ranges, "range").sortWithinPartitions("range", "page_id", "place")
    manifest = ordered.drop("place").mapInArrow(_writer(folder, file_bytes), MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The compressed members of a file one by one."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("the file ends inside a record")
            return
        parts.append(unpacker.decompress(data))
        rest = b""
        if unpacker.eof:
            rest = unpacker.unused_data
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def read_record(data: bytes) -> dict | None:
    """What a record says of its page, its digests checked; None for other records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if _sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"wrong block digest in {fields['WARC-Record-ID']}")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"]
    if kind == "response" and _sha1(payload) != digest:
        raise ValueError(f"wrong payload digest in {fields['WARC-Record-ID']}")
    page, target = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page),
        "url": _unfield(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_bytes": int(http_fields["Content-Length"]),
        "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
        "record_type": kind,
        "refers_to": None if target is None else int(target),
    }


def _reader(folder: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                found, records = [], 0
                with store.open_input_stream(f"{path}/{row['file']}", compression=None) as stream:
                    for member in _members(stream):
                        record = read_record(member)
                        if record is None:
                            continue
                        records += 1
                        found.append(record)
                        if len(found) == 1000:
                            yield _rows(found, RECORDS)
                            found = []
                if records != row["records"]:
                    raise ValueError(f"{row['file']} has {records} records")
                yield _rows(found, RECORDS)

    return read


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record in the files that the manifest names, its digests checked.

    Missing ids and urls come back missing, repeated rows each; a manifest without files
    gives no rows. A file without the records that the manifest says fails the query."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "file").mapInArrow(_reader(folder), RECORDS)


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
    CASE WHEN octet_length(payload) >= 1000
      THEN max(page_id) OVER (PARTITION BY sha1(payload)) END AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d
"""
