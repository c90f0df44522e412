"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, manifests as commit."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundledger.llm.common import bound_batches, materialize

MIN_REVISIT = 1000
#: Payload bytes of a shard, and compressed bytes after which a file is closed.
SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
#: Equal-width ranges of ids whose bytes are counted to place the shard borders.
RANGES = 4096
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("00000000-0000-5000-8000-000000000000")


def _folder(uri: str):
    """File system and path of a shared folder; tasks reach it without Spark."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a clock in it."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit that names the page holding the same payload. Headers and digests are made anew."""
    http = _http(len(payload))
    block = http if keeper is not None else http + payload
    headers = [
        ("WARC-Type", "response" if keeper is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
    ]
    if page is not None:
        headers.append(("WARC-Page-ID", str(page)))
    if keeper is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(keeper, digest)),
            ("WARC-Refers-To-Page-ID", str(keeper)),
        ]
    return _member(headers, block)


class _Files:
    """Files of one shard, each written under a temporary name and moved when it is whole."""

    def __init__(self, folder: str, shard: int, limit: int) -> None:
        self.folder, self.shard, self.limit, self.number, self.done = folder, shard, limit, 0, []
        self.fs, self.path = _folder(folder)
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(self.name, "")), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.name, self.shard, self.number, self.records, self.size, self.digest.hexdigest()))
            self.number, self.out = self.number + 1, None


def shard_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages ``(page_id, url, payload, digest, shard, kind 1)`` and marks ``(page_id, digest, keeper, shard, kind 0)``, sorted.

    Shards are ranges of ids; a shard's rows are together, and a mark comes right before the page that it makes a revisit
    of ``keeper``. Digests and lengths alone are grouped and joined, so that payloads are shuffled once. Shard borders
    come from bytes per range of ids, not from a sample, so that reruns give the same files.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    slim = materialize(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    long_rows = slim.filter(F.col("bytes") >= min_revisit)
    keepers = long_rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = long_rows.join(materialize(keepers, "warc-keepers"), "digest")
    marks = copies.filter(~F.col("keeper").eqNullSafe(F.col("page_id")) & F.col("keeper").isNotNull()).select("page_id", "digest", "keeper").distinct()
    ends = slim.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("bytes") + 512)).first()
    low, high = (ends[0] or 0), (ends[1] or 0)
    slot = F.coalesce(F.floor((F.col("page_id") - low) / F.lit(max(1.0, (high - low + 1) / RANGES))).cast("int"), F.lit(-1))
    # At most RANGES + 1 rows: ordered in one task, and safe to broadcast.
    filled = slim.groupBy(slot.alias("slot")).agg(F.sum(F.col("bytes") + 512).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = filled.select("slot", F.floor(before / shard_bytes).cast("int").alias("shard"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    met = both.withColumn("slot", slot).join(F.broadcast(shards), "slot").drop("slot")
    # As many tasks as shards: a task's share does not grow with the table.
    return met.repartition(max(1, -(-(ends[2] or 0) // shard_bytes)), "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, **columns: object) -> DataFrame:
    """Write the pages below ``folder`` and return the manifest: file, shard, part, records, bytes, sha1.

    A task writes under a temporary name and moves a whole file to its final one; a task that runs again writes the same
    bytes. The manifest table, written last, is the commit: files it doesn't name don't count.
    """
    fs, path = _folder(folder)
    fs.create_dir(path, recursive=True)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: _Files | None = None
        made: list[tuple] = []
        marked: tuple = ()
        for pdf in batches:
            for page, url, payload, digest, keeper, shard, kind in zip(*(pdf[c].array for c in ("page_id", "url", "payload", "digest", "keeper", "shard", "kind")), strict=True):
                if kind == 0:
                    marked = (page, digest, int(keeper))
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        made += files.done
                    files = _Files(folder, int(shard), file_bytes)
                files.add(record(None if pd.isna(page) else int(page), url, bytes(payload), digest, marked[2] if marked[:2] == (page, digest) else None))
        if files is not None:
            files.close()
            made += files.done
        yield pd.DataFrame(made, columns=["file", "shard", "part", "records", "bytes", "sha1"])

    bound_batches(pages.sparkSession)
    rows = shard_records(pages, **columns)
    # Ids pass as text: a null must not turn a column of longs into floats.
    rows = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("keeper", F.col("keeper").cast("string"))
    rows.mapInPandas(work, "file string, shard int, part int, records long, bytes long, sha1 string").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record starts here: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield headers, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` of every record that the manifest commits.

    Block and payload digests are computed again; one that differs from its header ends the job.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _folder(folder)
        for pdf in batches:
            for name in pdf["file"]:
                out: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw)) as stream:
                    for headers, block in parse(stream):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        digest = headers["warc-payload-digest"]
                        if _sha1(block) != headers["warc-block-digest"] or kind == "response" and _sha1(body) != digest:
                            raise ValueError(f"a digest differs in {name}")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        out.append((headers.get("warc-page-id"), headers["warc-target-uri"], size, base64.b32decode(digest[5:]).hex(), kind, headers.get("warc-refers-to-page-id"), *([body] if payloads else [])))
                        if len(out) >= 2000 or payloads and len(out) >= 50:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                yield pd.DataFrame(out, columns=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    rows = files.repartition(max(1, files.count())).mapInPandas(work, schema)
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def warc_round_trip(pages: DataFrame, folder: str, **columns: object) -> DataFrame:
    """Write every page, then read the archives back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Null html is an empty payload; null urls get a made-up URI; pages without an id are written, and never referred to.
    Rows repeated with one id are responses alike if that id is the largest of their payload. Other columns are ignored.
    An empty table writes a manifest without files and gives no rows.
    """
    write_warc(pages, folder, **columns)
    return read_warc(pages.sparkSession, folder).drop("url")
