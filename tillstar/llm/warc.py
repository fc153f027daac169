"""Deterministic sharded WARC files.

Records are sorted by page id over ranges that depend on the data alone; each
range is one shard, written in order and rolled into a new file whenever its
compressed size is reached. Headers and digests are made anew from the
payload, dates are a parameter, and every record is a gzip member of its own,
so the same pages give the same bytes whatever the cluster does.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.llm import shards
from tillstar.llm.common import key_bounds, map_sorted_groups, range_column
from tillstar.session import delete_at_end, discard, new_folder, settle

#: Payload bytes of a shard, compressed bytes after which a file is closed, and
#: the payload size from which equal payloads are written once.
SHARD_BYTES, ROLL_BYTES, REVISIT_BYTES = 8 << 20, 1 << 20, 0
#: Date of every record; fixed, as the pages carry none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGES = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string"
_PAGES_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
    ]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def one_line(value: str) -> str:
    """Control characters would end a header line; they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as one gzip member without a time stamp."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", one_line(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(headers, block)


def file_info(name: str) -> bytes:
    text = b"software: tillstar\r\nformat: WARC File Format 1.1\r\n"
    headers = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
    ]
    return member(headers, text)


def _writer(folder: str, roll: int):
    def write(groups):
        for (shard,), rows in groups:
            done, current, part = [], None, 0
            of_page, revisits = None, {}
            for page_id, kind, refers_to, digest, size, url, html in rows:
                if kind == 0:  # says what the page's rows with this payload, which follow, refer to
                    revisits = {**(revisits if of_page == page_id else {}), (digest, size): refers_to}
                    of_page = page_id
                    continue
                payload, first = (html or "").encode(), None
                if revisits and of_page == page_id:
                    first = revisits.get((hashlib.sha1(payload).hexdigest(), len(payload)))
                if current is None:
                    current = shards.ShardFile(folder, f"pages-{shard:05d}-{part:05d}.warc.gz")
                    current.write(file_info(current.name))
                current.write(page_record(page_id, url, payload, first), 1)
                if current.bytes >= roll:
                    done.append(current.close())
                    current, part = None, part + 1
            if current is not None:
                done.append(current.close())
            if done:
                yield shards.manifest_batch(done)

    return write


def write_pages(pages: DataFrame, folder: str, per_shard: int = SHARD_BYTES, roll: int = ROLL_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Write one record per page below ``folder``; returns the manifest.

    Of the pages with equal payloads of at least ``least`` bytes the one with
    the smallest page_id is a response and the others are revisits of it;
    smaller ones are all responses. Equality is that of digest and length.

    Null payloads are empty; null urls have no target header; control
    characters in urls are percent-encoded. Rows that repeat a page_id are
    records of their own; a null page_id is never a revisit. An empty table
    gives an empty manifest. Further columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = settle(pages.select("page_id", F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload).alias("digest")), "warc-pages")
    first = (
        narrow.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    revisits = narrow.join(first, ["digest", "size"]).filter("page_id > refers_to").select("page_id", "refers_to", "digest", "size").distinct()
    bounds = key_bounds(narrow.withColumn("weight", F.col("size") + 256), "page_id", "weight", per_shard)
    records = pages.select("page_id", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("refers_to"), "url", "html").unionByName(
        revisits.withColumn("kind", F.lit(0)), allowMissingColumns=True
    )
    ranged = records.select(range_column("page_id", bounds).alias("shard"), "page_id", "kind", "refers_to", "digest", "size", "url", "html")
    written = map_sorted_groups(ranged, ["shard"], ["page_id", "kind", "url", "html"], _writer(folder, roll), shards.MANIFEST)
    manifest = shards.commit(written, folder)
    discard(narrow)
    return manifest


def members(stream) -> Iterator[bytes]:
    """The uncompressed records of an archive, one at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = rest or stream.read(1 << 18)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("archive ends within a record")
                return
            parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1" or len(block) != int(headers["Content-Length"]) + 4:
        raise ValueError(f"not a whole WARC record: {version} {headers}")
    return headers, block[:-4]


def page_of(headers: dict[str, str], block: bytes, file: str) -> tuple:
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
    if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
    if kind == "response":
        size, digest = len(payload), base32_sha1(payload)
        if f"sha1:{digest}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest of {headers['WARC-Record-ID']} differs")
    refers_to = id_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return id_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, kind, refers_to, file


def read_pages(manifest: DataFrame) -> DataFrame:
    """The page records of the archives, every digest checked against its bytes."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES_ARROW, strict=True)], schema=_PAGES_ARROW)

    def read(path, fs, inner):
        rows, file = [], path.rpartition("/")[2]
        with fs.open_input_stream(inner, compression=None) as stream:
            for record in members(stream):
                headers, block = parse(record)
                if headers["WARC-Type"] != "warcinfo":
                    rows.append(page_of(headers, block, file))
                if len(rows) == 1000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return shards.read_files(manifest, read, PAGES)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, which go with the
    application, and read them back."""
    folder = new_folder(spark, "warc")
    manifest = write_pages(pages, folder)
    delete_at_end(spark, folder)
    return read_pages(manifest)
