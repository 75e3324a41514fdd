"""A deterministic sharded WARC writer and its reader.

Records go by page_id and payload digest.  Ranges of about equal bytes form shards, a function of the data alone; a task streams
its shards in order, one gzip member a record, and starts a new file where the compressed size reaches the roll size.
Headers and digests are made anew from the payload.  Every attempt of a task writes under temporary names of its own and lists them;
only the lists of the attempts that Spark commits are kept, and a second step gives exactly those files their final names, a step
that can be run again at any point.  The manifest is written last, and the reader holds each file against it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.ordered import running_totals
from tideline.llm.scratch import drop, materialize, new_folder

DATE = "2026-01-01T00:00:00Z"
SHARD_BYTES = 32 << 20
#: Tasks of the writer at most; with more shards each task streams several, one after the other.
MOST_TASKS = 16_384
#: Bytes of archives that a reading task takes, about.
READ_BYTES = 8 << 20
ROLL_BYTES = 8 << 20
ATTEMPTS = "_attempts"
MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string"
RECORDS = "file string, record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to long"


def _open_fs(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own; no clock goes in."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class _Files:
    """The rolled files of one shard."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = _open_fs(folder)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None

    def write(self, member: bytes) -> Iterator[dict]:
        if self.out is None:
            self.name = f"part-{self.shard:07d}-{self.part:05d}.warc.gz"
            self.temporary = f"{ATTEMPTS}/{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            info = b"software: tideline\r\nformat: WARC File Format 1.1\r\n"
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1
        if self.size >= self.roll:
            yield self.close()

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> dict:
        self.out.close()
        done = {"temporary": self.temporary, "file": self.name, "shard": self.shard, "part": self.part, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}
        self.out, self.part = None, self.part + 1
        return done


def _record_id(page_id: int | None, digest: str, n: int) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}:{n}>"


def _page_record(page_id: int | None, n: int, url: str | None, payload: bytes, owner: int | None, revisit: bool) -> bytes:
    digest = _base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE), ("WARC-Record-ID", _record_id(page_id, digest, n))]
    headers.append(("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~")))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(owner, digest, 0))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block)


_LISTED = [("file", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]


def _writer(folder: str, roll: int):
    schema = pa.schema([("temporary", pa.string()), *_LISTED])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, owner, n = None, None, None, 0
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if files is None or files.shard != r["shard"]:
                    if files and files.out:
                        done.append(files.close())
                    files = _Files(folder, r["shard"], roll)
                if r["kind"] == 0:  # what is decided for the rows of this page_id and payload, which follow
                    key, owner, n = (r["page_id"], r["digest"]), r["owner"], 0
                    continue
                if key != (r["page_id"], r["digest"]):
                    raise ValueError(f"no decision for page {r['page_id']}")
                revisit = r["repeats"] and (n > 0 or r["page_id"] != owner)
                done += files.write(_page_record(r["page_id"], n, r["url"], r["payload"], owner, revisit))
                n += 1
            yield pa.RecordBatch.from_pylist(done, schema)
        if files and files.out:
            yield pa.RecordBatch.from_pylist([files.close()], schema)

    return write


def _publisher(folder: str):
    """Give the listed files their final names.  A file that has its final name already was published by an attempt before this one."""

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_fs(folder)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("file", "temporary", "bytes")), strict=True):
                if files.get_file_info(f"{root}/{temporary}").type == fs.FileType.File:
                    if files.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                        files.delete_file(f"{root}/{name}")
                    files.move(f"{root}/{temporary}", f"{root}/{name}")
                elif files.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} was lost between writing and publishing")
            yield batch.select([n for n, _ in _LISTED])

    return publish


def _shard_of(nulls: int, ids: np.ndarray, places: np.ndarray):
    """The shard of (page_id, place): how many shards end before it.  ``ids`` and ``places`` are the last keys of the shards, those
    of the ``nulls`` first without a page_id."""

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, place: pd.Series) -> pd.Series:
        has = page_id.notna().to_numpy()
        page = page_id.fillna(0).to_numpy(np.int64)
        lo = np.where(has, nulls + np.searchsorted(ids[nulls:], page, "left"), 0)
        hi = np.where(has, nulls + np.searchsorted(ids[nulls:], page, "right"), nulls)
        for at in np.unique(lo[hi > lo]):  # a page_id that several shards hold goes on by the place of its payload
            own = np.flatnonzero((lo == at) & (hi > lo))
            lo[own] = at + np.searchsorted(places[at : hi[own[0]]], place.to_numpy(np.int64)[own], "left")
        return pd.Series(lo.astype(np.int32))

    return shard_of


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` into ``folder``; returns the manifest, which it writes there too.

    The payload is the html in UTF-8 (null: empty).  Of rows with equal payloads of at least ``least_bytes`` bytes, that with the
    largest page_id is a response and the others are revisits of it; of repeated rows of that page_id, one.  Null
    page_ids count as least.  Null URLs are about:blank; characters that no URI holds are percent-encoded.  An
    empty table gives an empty manifest.

    Shards end between two keys of page_id and the first 32 bits of the payload's digest, so pages under one page_id, or under none, are
    shared out by their payloads.  The driver holds two numbers for each ``shard_bytes``.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long").alias("place")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    slim = materialize(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")), "payloads")
    keys = slim.groupBy("page_id", place).agg(F.sum(F.col("bytes") + 512).alias("size"))
    placed = running_totals(keys, [F.col("page_id").asc_nulls_first(), "place"], ["size"], "pages")
    number = F.floor((F.col("total_size") - F.col("size")) / shard_bytes)
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"), F.col("place").alias("place"))).alias("last")
    ends = placed.groupBy(number.alias("shard")).agg(last).orderBy("shard").select("last.known", F.coalesce("last.id", F.lit(0)).alias("id"), "last.place").toPandas()[:-1]
    shard_of = _shard_of(int((~ends["known"].to_numpy(bool)).sum()), ends["id"].to_numpy(np.int64), ends["place"].to_numpy(np.int64))
    shards = len(ends) + 1
    tasks = min(shards, MOST_TASKS)

    owners = slim.groupBy("digest").agg(F.max("page_id").alias("owner"))
    decided = slim.select("page_id", "digest").distinct().join(owners, "digest").select("page_id", "digest", F.lit(0).alias("kind"), "owner", F.lit(False).alias("repeats"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    records = rows.select("page_id", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("owner"), (F.octet_length("payload") >= least_bytes).alias("repeats"), "url", "payload")
    dealt = decided.unionByName(records).withColumn("shard", shard_of("page_id", place))
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int"))
    written = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url").mapInArrow(_writer(folder, roll_bytes), f"temporary string, {MANIFEST}")
    files, root = _open_fs(folder)
    files.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
    listed = materialize(written, "attempts")
    published = listed.repartition(min(MOST_TASKS, 1 + listed.count() // 64), "file").mapInArrow(_publisher(folder), MANIFEST)
    published.write.mode("overwrite").parquet(f"{folder}/manifest")
    files.delete_dir(f"{root}/{ATTEMPTS}")
    drop(listed)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other, read in pieces."""
    left, member, out = b"", zlib.decompressobj(31), io.BytesIO()
    while True:
        data = left or stream.read(1 << 16)
        if not data:
            if out.tell():
                raise ValueError("a member is cut off")
            return
        out.write(member.decompress(data))
        left = b""
        if member.eof:
            left = member.unused_data
            yield out.getvalue()
            member, out = zlib.decompressobj(31), io.BytesIO()


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]}")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return None if page == "null" else int(page)


def _reader(folder: str):
    schema = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_fs(folder)
        for name, *listed in (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("file", "records", "bytes", "sha256")), strict=True)):
            rows, n = [], 0
            with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                counted = _Counted(stream)
                for record in _members(counted):
                    h, block = _parse(record)
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    n += 1
                    if h["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).digest())}":
                        raise ValueError(f"{name}: block digest of {h['WARC-Record-ID']}")
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if digest != _base32(hashlib.sha1(payload).digest()):
                            raise ValueError(f"{name}: payload digest of {h['WARC-Record-ID']}")
                    to = h.get("WARC-Refers-To")
                    rows.append({"file": name, "record_id": h["WARC-Record-ID"], "record_type": h["WARC-Type"], "page_id": _page_of(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "refers_to_id": to, "refers_to": to and _page_of(to)})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            if [n, counted.bytes, counted.sha.hexdigest()] != listed:
                raise ValueError(f"{name} is not the file that the manifest lists")
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read


class _Counted:
    """A stream that counts and hashes what is read of it."""

    def __init__(self, stream):
        self.stream, self.bytes, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.bytes += len(data)
        self.sha.update(data)
        return data


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """``RECORDS`` of the archives that ``manifest`` lists; payload_bytes is null for revisits.

    Digests of blocks and payloads are checked, and each file's records, bytes and hash against the manifest.  Files are dealt to
    tasks of about READ_BYTES; an empty manifest gives no rows.
    """
    placed = running_totals(manifest.select("file", "records", "bytes", "sha256"), ["file"], ["bytes"], "files")
    task = F.floor((F.col("total_bytes") - F.col("bytes")) / READ_BYTES).cast("int")
    tasks = 1 + (placed.agg(F.max(task)).first()[0] or 0)
    return placed.repartitionById(min(tasks, MOST_TASKS), task).mapInArrow(_reader(folder), RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: a row a record, revisits with the size of what they refer to.

    Nulls, repeated rows and ties are as in ``write_warc``; no pages give no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    records = materialize(read_warc(write_warc(pages, folder, least_bytes), folder), "records")
    full = records.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    joined = records.join(full, (F.coalesce("refers_to_id", "record_id")) == F.col("of"), "left")
    return joined.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
