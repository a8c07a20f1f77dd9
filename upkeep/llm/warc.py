"""Deterministic sharded WARC writer and reader.

Records are ordered by page id. A running sum of payload bytes in that order
(worked out over ids and lengths only) cuts shards of ``shard_bytes``; the sum
doesn't depend on how the input is partitioned, so neither do the shards. Each
shard is written by one task, record by record, as one gzip member each, into
files that are rolled when their compressed size passes ``roll_bytes``.
Headers, ids and digests are made anew from the payload. Equal payloads (SHA-1
and length) of ``revisit_bytes`` or more: the smallest page id is the response,
the others are revisits of it.

A task writes under a temporary name of its own and reports it in the manifest,
a table that Spark commits: of repeated or lost attempts only the one that
counted is in it. The files are then renamed to their final names and the
leftovers removed. Files go through pyarrow's file systems (local, HDFS, object
stores).

Cases: null html is an empty payload, null urls an empty target; rows with a
null page id come first and are always responses; of repeated rows with the
smallest id the first is the response and the others revisit that id; an empty
table writes no file and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import prefix_sums, shared_path, written

SHARD_BYTES = 32 << 20
ROLL_BYTES = 4 << 20
REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"  # a fixed capture date keeps the archives reproducible
_MANIFEST = "shard long, seq long, temporary string, name string, records long, bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>",
             f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zip_.compress(head + block + b"\r\n\r\n") + zip_.flush()


def records(data: bytes):
    """(headers, block) of every record of an archive; raises on a wrong digest."""
    view, at = memoryview(data), 0
    while at < len(data):
        unzip, raw, fed = zlib.decompressobj(31), [], at
        while not unzip.eof and fed < len(data):
            raw.append(unzip.decompress(view[fed:fed + 65_536]))
            fed = min(fed + 65_536, len(data))
        if not unzip.eof:
            raise ValueError("the archive ends inside a record")
        at = fed - len(unzip.unused_data)
        head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[:int(headers["Content-Length"])]
        if headers["WARC-Block-Digest"] != "sha1:" + digest(block):
            raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
        yield headers, block


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes ``out/part-<shard>-<seq>.warc.gz`` and returns the manifest."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    ids = prefix_sums(rows.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").cast("long").alias("len")),
                      [], ["page_id", "sha"], "len", "place", "warc")
    ids = written(ids, "warc-ids")
    cuts = ids.withColumn("shard", F.floor(F.col("place") / shard_bytes)).groupBy("shard").agg(F.min("page_id").alias("low"))
    # one number per shard: bounded by the bytes of the input over shard_bytes
    lows = np.array(sorted(r["low"] for r in cuts.where("low is not null").collect()), dtype=np.int64)

    @F.pandas_udf("long")
    def shard_of(page_id):
        known = page_id.notna().to_numpy()
        at = np.searchsorted(lows, page_id.fillna(0).astype("int64").to_numpy(), side="right") - 1
        return pd.Series(np.where(known, np.maximum(at, 0), 0))

    known = ids.where(F.col("page_id").isNotNull() & (F.col("len") >= revisit_bytes))
    first = written(known.groupBy(F.col("sha").alias("_sha"), F.col("len").alias("_len")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n"))
                    .where("_n > 1"), "first")
    roles = known.join(first, (F.col("sha") == F.col("_sha")) & (F.col("len") == F.col("_len"))).select("page_id", "sha", "first").distinct()
    # the roles travel with the pages and are sorted before the page they are for
    both = (rows.select("page_id", "url", "payload", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind"))
            .unionByName(roles.select("page_id", F.lit("").alias("url"), F.lit(b"").alias("payload"), "sha", "first", F.lit(0).alias("kind"))))
    dealt = (both.withColumn("shard", shard_of("page_id")).repartition(max(1, 2 * len(lows)), "shard")
             .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", F.length("payload"), "url"))

    def run(batches):
        store, base = pafs.FileSystem.from_uri(out)
        store.create_dir(f"{base}/_temporary", recursive=True)
        now = {"shard": None, "seq": 0, "parts": [], "size": 0, "page": object(), "roles": {}, "used": set()}
        done = []

        def close():
            if now["parts"]:
                temporary = f"_temporary/{now['shard']:08d}-{now['seq']:05d}-{uuid.uuid4().hex}"
                with store.open_output_stream(f"{base}/{temporary}") as f:
                    for part in now["parts"]:
                        f.write(part)
                done.append((now["shard"], now["seq"], temporary, f"part-{now['shard']:08d}-{now['seq']:05d}.warc.gz", len(now["parts"]), now["size"]))
                now.update(seq=now["seq"] + 1, parts=[], size=0)

        def told():
            got, done[:] = list(done), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], pa.string() if i in (2, 3) else pa.int64()) for i in range(6)],
                                              ["shard", "seq", "temporary", "name", "records", "bytes"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "sha", "first", "kind")]
            for shard, page, url, payload, sha, first, kind in zip(*cols):
                if shard != now["shard"]:
                    close()
                    now.update(shard=shard, seq=0, page=object())
                if page != now["page"]:
                    now.update(page=page, roles={}, used=set())
                if kind == 0:
                    now["roles"][sha] = first
                    continue
                refers, hexed = None, None
                if page is not None and now["roles"]:
                    hexed = hashlib.sha1(payload).hexdigest()
                    first = now["roles"].get(hexed)
                    if first is not None and (first != page or hexed in now["used"]):
                        refers = first
                    now["used"].add(hexed)
                data = record(page, url, payload, refers)
                now["parts"].append(data)
                now["size"] += len(data)
                if now["size"] >= roll_bytes:
                    close()
            if done:
                yield told()
        close()
        yield told()

    manifest = written(dealt.mapInArrow(run, _MANIFEST), "manifest")

    def rename(batches):
        store, base = pafs.FileSystem.from_uri(out)
        for b in batches:
            for temporary, name in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist()):
                # a repeated attempt finds the file in its place
                if store.get_file_info(f"{base}/{temporary}").type != pafs.FileType.NotFound:
                    store.move(f"{base}/{temporary}", f"{base}/{name}")
            yield b

    moved = written(manifest.mapInArrow(rename, _MANIFEST), "manifest")
    store, base = pafs.FileSystem.from_uri(out)
    if store.get_file_info(f"{base}/_temporary").type != pafs.FileType.NotFound:
        store.delete_dir(f"{base}/_temporary")
    return moved


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """Every record of ``out/part-*.warc.gz``: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, url, payload`` (null for revisits)."""
    files = spark.read.format("binaryFile").load(f"{out}/part-*.warc.gz").select("content")
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")

    def page(uri):
        name = uri[len("<urn:x-page:"):-1]
        return int(name) if name else None

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                got = []
                for headers, block in records(b.column("content")[k].as_buffer().to_pybytes()):
                    revisit = headers["WARC-Type"] == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    sha = headers["WARC-Payload-Digest"][5:]
                    if payload is not None and sha != digest(payload):
                        raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
                    got.append((page(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), sha, headers["WARC-Type"],
                                page(headers["WARC-Refers-To"]) if revisit else None, headers["WARC-Target-URI"], payload))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], kinds[i]) for i in range(7)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to a fresh folder of the shared store and reads them back."""
    out = shared_path(pages.sparkSession, "warc")
    if write_warc(pages, out, **options).isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(pages.sparkSession, out).drop("url", "payload")
