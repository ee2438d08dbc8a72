"""WARC archives with a two-level capture index.

Pages are range-partitioned by key (reversed host, then path, then id) and sorted, so
a task writes one archive in key order: a gzip member per record. Beside it the task
writes the index: JSON lines in compressed blocks, and a sparse directory with the
first key and the place of each block. The manifest has a row per archive. A reader
searches the manifest for the archive, the directory for the block and the block
for the record (all by bisection), then reads just the record's bytes.

Files are written through Arrow's file systems below a shared folder, under names of
their own per attempt; the manifest names only those of attempts that ended well, so
a task that is run again leaves at most files that nobody reads.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import urlfilter

#: Index lines of a compressed block.
BLOCK_LINES = 512
#: Payloads below so many bytes are stored again rather than referred to.
LEAST_REVISIT = 100
#: Signs that stay as they are in a head field; a percent sign is written as %25, so that reading is exact.
SIGNS = "".join(chr(c) for c in range(33, 127) if c != 37)


def capture_key(url: Column, key: Column) -> Column:
    """Reversed host, path and query, then the id: `com,example,www)/a?b 17`. Without a host the whole URL stands first."""
    host = F.array_join(F.reverse(F.split(urlfilter.host_of(url), r"\.")), ",")
    rest = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*(.*)$", 1)
    return F.concat(F.coalesce(F.concat(host, F.lit(")"), rest), url, F.lit("")), F.lit(" "), F.coalesce(key.cast("string"), F.lit("-")))


def member(head: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(payload)))]) + "\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(lines.encode() + payload + b"\r\n\r\n") + pack.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Head fields and payload of a record's gzip member."""
    raw = zlib.decompress(data, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    head = dict(line.split(": ", 1) for line in lines)
    size = int(head["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError(f"{head.get('WARC-Record-ID')}: {len(rest) - 4} bytes instead of {size}")
    return head, rest[:size]


def packed(body: Column) -> Column:
    """The body, compressed for the shuffles on its way to its archive."""

    @F.arrow_udf("binary")
    def pack(bodies: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(x, 1) for x in bodies.cast(pa.binary()).to_pylist()], pa.binary())

    return pack(body)


def _opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes a record per row and returns the manifest: (name, first_key, last_key, records), staged.

    Payloads are UTF-8 (null: empty). Of rows with equal payloads of at least
    LEAST_REVISIT bytes, those with the smallest key are responses, the rest revisits
    that name it; rows with a null key are never referred to unless no other has one.
    An archive holds about `archive_bytes` of payloads, or less where more tasks can run at once.
    """
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    archives = max(spark.sparkContext.defaultParallelism, -(-total // archive_bytes))
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), body.alias("_body"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_size"))
    copies = rows.where(F.col("_size") >= LEAST_REVISIT).groupBy("_digest").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_url").alias("url"))).alias("_first")).where("_n > 1").select(F.col("_digest").alias("_of"), "_first")
    rows = rows.withColumn("_packed", packed(F.col("_body"))).drop("_body").join(copies, F.col("_digest") == F.col("_of"), "left")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_first.id")) & F.col("_of").isNotNull(), F.col("_first.id"))
    target = F.when(refers.isNotNull(), capture_key(F.col("_first.url"), F.col("_first.id")))
    rows = rows.select(capture_key(F.col("_url"), F.col("_id")).alias("capture"), F.col("_id").cast("string").alias("id"), F.coalesce("_url", F.lit("")).alias("url"), F.col("_packed").alias("body"), "_digest", refers.cast("string").alias("refers_to"), target.alias("target"))

    def archive(batches):
        name, fs, out, at, lines, first, last, count = uuid.uuid4().hex, None, None, 0, [], None, None, 0
        index, directory = None, []

        def close_block():
            if lines:
                data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
                directory.append([lines[0][0], index.tell(), len(data)])
                index.write(data)
                lines.clear()

        for batch in batches:
            for capture, ident, link, data, digest, refers_to, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, root = _opened(folder)
                    fs.create_dir(root, recursive=True)
                    out, index = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None), fs.open_output_stream(f"{root}/{name}.idx")
                head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{ident or ''}>"), ("WARC-Target-URI", quote(link, safe=SIGNS + "%")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "text/html")]
                if refers_to is not None:
                    head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Capture", quote(target, safe=SIGNS + " "))]
                record = member(head, b"" if refers_to is not None else zlib.decompress(data))
                out.write(record)
                lines.append([capture, at, len(record)])
                at += len(record)
                first, last, count = capture if first is None else first, capture, count + 1
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is None:
            return
        close_block()
        out.close()
        index.close()
        with fs.open_output_stream(f"{_opened(folder)[1]}/{name}.dir") as sparse:
            sparse.write(zlib.compress(json.dumps(directory).encode()))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([last]), pa.array([count], pa.int64())], ["name", "first_key", "last_key", "records"])

    ordered = rows.repartitionByRange(archives, "capture").sortWithinPartitions("capture")
    return stage(ordered.mapInArrow(archive, "name string, first_key string, last_key string, records long"), "warc-manifest")


class Reader:
    """Range reads through the index; keeps the few files, directories, blocks and payloads used last."""

    def __init__(self, folder: str, manifest: list[tuple[str, str, str]]):
        self.fs, self.root = _opened(folder)
        self.manifest = sorted((first.encode(), last.encode(), name) for name, first, last in manifest)
        self.firsts = [m[0] for m in self.manifest]
        self.opened = functools.lru_cache(16)(lambda path: self.fs.open_input_file(f"{self.root}/{path}"))
        self.directory = functools.lru_cache(64)(self._directory)
        self.block = functools.lru_cache(32)(self._block)
        self.payload = functools.lru_cache(256)(self._payload)

    def _directory(self, name: str) -> tuple[list[bytes], list[list]]:
        with self.fs.open_input_stream(f"{self.root}/{name}.dir") as f:
            rows = json.loads(zlib.decompress(f.read()))
        return [r[0].encode() for r in rows], rows

    def _block(self, name: str, at: int, size: int) -> tuple[list[bytes], list[list]]:
        rows = [json.loads(x) for x in zlib.decompress(self.opened(f"{name}.idx").read_at(size, at)).split(b"\n")]
        return [r[0].encode() for r in rows], rows

    def entries(self, capture: str) -> list[tuple[str, list]]:
        """(archive, index line) of every record of a key."""
        key, out = capture.encode(), []
        for place in range(bisect_right(self.firsts, key) - 1, -1, -1):
            _, last, name = self.manifest[place]
            if last < key:
                break  # archives hold ranges that don't overlap
            keys, rows = self.directory(name)
            for i in range(max(0, bisect_left(keys, key) - 1), bisect_right(keys, key)):
                inside, lines = self.block(name, rows[i][1], rows[i][2])
                out += [(name, x) for x in lines[bisect_left(inside, key) : bisect_right(inside, key)]]
        return out

    def record(self, name: str, line: list) -> tuple[dict[str, str], bytes]:
        return parsed(self.opened(f"{name}.warc.gz").read_at(line[2], line[1]))

    def _payload(self, capture: str) -> tuple[int, str]:
        """Size and digest of the response of a key."""
        for name, line in self.entries(capture):
            head, data = self.record(name, line)
            if head["WARC-Type"] == "response":
                return len(data), hashlib.sha256(data).hexdigest()
        raise KeyError(f"no response for {capture!r}")


def read(wanted: DataFrame, folder: str, manifest: DataFrame, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to): every record of the wanted keys, from the archives.

    Digest and size are those of the bytes read; a revisit's are those of the response it
    names. A key with several records (repeated rows) gives each once; one without fails.
    """
    kind = wanted.schema[key].dataType.simpleString()
    keys = wanted.select(capture_key(F.col(url), F.col(key)).alias("capture"), F.col(key).alias("id")).distinct()
    archives = [tuple(r) for r in manifest.select("name", "first_key", "last_key").collect()]  # a row per archive
    keys = keys.repartitionByRange(max(len(archives), 1), "capture").sortWithinPartitions("capture")
    shared = wanted.sparkSession.sparkContext.broadcast(archives)

    def fetch(batches):
        reader = Reader(folder, shared.value)
        for batch in batches:
            place, sizes, digests, kinds, refers = [], [], [], [], []
            for i, capture in enumerate(batch.column(0).to_pylist()):
                found = reader.entries(capture)
                if not found:
                    raise KeyError(f"no record for {capture!r}")
                for name, line in found:
                    head, data = reader.record(name, line)
                    of = head.get("WARC-Refers-To")
                    size, digest = (len(data), hashlib.sha256(data).hexdigest()) if of is None else reader.payload(unquote(head["WARC-Refers-To-Capture"]))
                    if head["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{capture!r}: the payload differs from its digest")
                    place.append(i)
                    sizes.append(size)
                    digests.append(digest)
                    kinds.append(head["WARC-Type"])
                    refers.append(of and of[len("<urn:page:") : -1])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(place, pa.int64())), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(kinds), pa.array(refers, pa.string())], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    got = keys.mapInArrow(fetch, f"id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return got.select(F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

