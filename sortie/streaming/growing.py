"""Logs that grow while they are read, as a stream of complete lines.

The offset of a batch is the size of each file as it was when the batch began. A line
belongs to the byte range that holds its line feed: whoever reads a range first goes
back to where its first line begins. So batches and the ranges inside them need not end
with a line, each complete line comes once, and a record that is still being written
waits for its line feed. Only sizes pass through the driver, of many logs a few at a time:
the offset then names a sorted listing of the sizes, and a task the ranges of a plan made
from two listings, both files below the option `listings`.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import fresh_folder
from ..sources.logs import labelled

#: Bytes that one task reads, what opening a file counts for among them, the bytes held at once, and those first looked at for a line's beginning.
RANGE, OPENING, PIECE, NEAR = 64 << 20, 1 << 16, 1 << 20, 1 << 12
#: Logs that an offset or a plan names itself, logs sorted at once, and those of a batch of a listing.
INLINE, SORTED, LISTED = 1000, 200_000, 2000
#: Folders of a remote store that are listed at once, and the threads that do so.
FOLDERS, THREADS = 128, 16

SIZES = pa.schema([("path", pa.string()), ("size", pa.int64())])
PARTS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


@dataclass
class ByteRanges(InputPartition):
    """(path, start, end) of what one task reads: a range of a large file, or many small ones; of many logs, batch `number` of a plan."""

    parts: list[tuple[str, int, int]]
    plan: str | None = None
    number: int = 0


def located(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def save_sizes(rows: Iterable[tuple[str, int]], out) -> None:
    rows = iter(rows)
    with pa.ipc.new_stream(out, SIZES, options=PACKED) as to:
        while some := list(islice(rows, LISTED)):
            to.write_batch(batch_of(some, SIZES))


def saved_sizes(file) -> Iterator[tuple[str, int]]:
    with file, pa.ipc.open_stream(file) as batches:
        for batch in batches:
            yield from rows_of(batch)


def files_below(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files below `folder`, in no order; never all of them at once."""
    if isinstance(files, fs.LocalFileSystem):
        with suppress(FileNotFoundError), os.scandir(folder) as entries:  # the folder is not there yet, or a file went meanwhile
            for x in entries:
                with suppress(FileNotFoundError):
                    if x.is_dir():
                        yield from files_below(files, x.path)
                    elif x.is_file():
                        yield x.path, x.stat().st_size
        return
    due = [folder]
    with ThreadPoolExecutor(THREADS) as pool:
        while due:
            now = due[-FOLDERS:]
            del due[-FOLDERS:]
            for found in pool.map(lambda at: files.get_file_info(fs.FileSelector(at, allow_not_found=True)), now):
                due += [x.path for x in found if x.type == fs.FileType.Directory]
                yield from ((x.path, x.size) for x in found if x.type == fs.FileType.File)


def in_order(sizes: Iterable[tuple[str, int]]) -> Iterator[tuple[str, int]]:
    """The sizes by path: sorted runs lie in temporary files of this process and are merged."""
    sizes, runs = iter(sizes), []
    while run := sorted(islice(sizes, SORTED)):
        file = tempfile.TemporaryFile()
        save_sizes(run, file)
        file.seek(0)
        runs.append(saved_sizes(file))
    return heapq.merge(*runs)


def with_start(start: Iterator[tuple[str, int]], end: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int, int]]:
    """(path, size before or 0, size) of the logs of `end`; both are sorted."""
    before = next(start, None)
    for path, size in end:
        while before and before[0] < path:
            before = next(start, None)
        yield path, before[1] if before and before[0] == path else 0, size


def line_start(file, at: int) -> int:
    """Where the line that holds byte `at` begins: after the last line feed before it."""
    step = NEAR
    while at > 0:
        low, step = max(0, at - min(step, PIECE)), 2 * step
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_of(file, start: int, end: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of (first bytes, lines) of the lines whose line feed is in [start, end)."""
    at = line_start(file, start)
    file.seek(at)
    rest, read = b"", at
    while read < end:
        piece = file.read(min(PIECE, end - read))
        if not piece:
            raise ValueError("a log shrank while it was read")
        read += len(piece)
        *whole, rest = (rest + piece).split(b"\n")
        places = []
        for line in whole:
            places.append(at)
            at += len(line) + 1
        # of a line that began before `start`, the line feed may lie there too
        kept = [k for k, line in enumerate(whole) if places[k] + len(line) >= start]
        yield [places[k] for k in kept], [whole[k].removesuffix(b"\r") for k in kept]


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".log")
        self.range, self.tasks = int(options.get("range_bytes", RANGE)), int(options.get("tasks", 1))
        self.listings, self.inline = options.get("listings", "").rstrip("/"), int(options.get("inline", INLINE))
        self.last, self.made = None, []  # digest and offset of the last listing; listings and plans not yet removed

    def _made(self, kind: str) -> tuple[fs.FileSystem, str]:
        files, folder = located(self.listings)
        files.create_dir(folder, recursive=True)
        self.made.append(f"{self.listings}/{kind}-{uuid.uuid4().hex}.arrow")
        return files, located(self.made[-1])[1]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, top = located(self.root)
        logs = ((path[len(top) :].lstrip("/"), size) for path, size in files_below(files, top) if path.endswith(self.suffix))
        if not self.listings:
            return dict(sorted(logs))
        first = list(islice(logs, self.inline + 1))
        if len(first) <= self.inline:
            return dict(sorted(first))
        digest, count = hashlib.blake2b(), 0

        def seen(rows: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int]]:
            nonlocal count
            for row in rows:
                digest.update(f"{row[0]}\0{row[1]}\0".encode())
                count += 1
                yield row

        store, place = self._made("sizes")
        with store.open_output_stream(place) as out:
            save_sizes(seen(in_order(chain(first, logs))), out)
        if self.last and self.last[0] == digest.digest():  # nothing new: the same offset
            store.delete_file(place)
            self.made.pop()
        else:
            self.last = digest.digest(), {"listing": self.made[-1], "logs": count}
        return self.last[1]

    def _sizes(self, offset: dict) -> Iterator[tuple[str, int]]:
        """(path, size) by path of an offset, which holds the sizes or names their listing."""
        if not isinstance(offset.get("listing"), str):
            return iter(sorted(offset.items()))
        files, place = located(offset["listing"])
        return saved_sizes(files.open_input_stream(place))

    def _grown(self, start: dict, end: dict) -> Iterator[tuple[str, int, int]]:
        for path, low, size in with_start(self._sizes(start), self._sizes(end)):
            if size < low:
                raise ValueError(f"{path} shrank from {low} to {size} bytes")
            if size > low:
                yield path, low, size

    def _dealt(self, start: dict, end: dict) -> Iterator[list[tuple[str, int, int]]]:
        """The parts of each task."""
        # few small files are dealt over all tasks that can run at once
        due = 0
        for _, low, size in self._grown(start, end):
            due += size - low + OPENING
            if due >= self.range * self.tasks:
                break
        share, room, parts = min(self.range, due // self.tasks), 0, []
        for path, low, size in self._grown(start, end):
            for at in range(low, size, self.range):
                stop = min(at + self.range, size)
                if parts and room < stop - at:
                    yield parts
                    parts = []
                if not parts:
                    room = share
                parts.append((path, at, stop))
                room -= stop - at + OPENING
        if parts:
            yield parts

    def partitions(self, start: dict, end: dict) -> list[ByteRanges]:
        dealt, first, named = self._dealt(start, end), [], 0
        for parts in dealt:
            first.append(parts)
            named += len(parts)
            if self.listings and named > self.inline:
                break
        else:
            return [ByteRanges(parts) for parts in first]
        store, place = self._made("plan")
        plan, out = self.made[-1], []
        with store.open_output_stream(place) as file, pa.ipc.new_file(file, PARTS, options=PACKED) as to:
            for parts in chain(first, dealt):
                to.write_batch(batch_of(parts, PARTS))
                out.append(ByteRanges([], plan, len(out)))
        return out

    def commit(self, end: dict) -> None:
        """What was made before the listing of `end` is asked for no more."""
        if end.get("listing") in self.made:
            keep = self.made.index(end["listing"])
            for old in self.made[:keep]:
                files, place = located(old)
                with suppress(FileNotFoundError):
                    files.delete_file(place)
            del self.made[:keep]

    def _parts(self, partition: ByteRanges) -> list[tuple[str, int, int]]:
        if partition.plan is None:
            return partition.parts
        files, place = located(partition.plan)
        with files.open_input_file(place) as file:
            return list(rows_of(pa.ipc.open_file(file).get_batch(partition.number)))

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        files, top = located(self.root)
        paths, ats, texts, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ats, pa.int64()), pa.array(texts, pa.string())], ["log_path", "at", "line"])

        for path, start, end in self._parts(partition):
            with files.open_input_file(f"{top}/{path}") as file:
                for places, lines in lines_of(file, start, end):
                    paths += [path] * len(lines)
                    ats += places
                    texts += [line.decode("utf-8", "replace") for line in lines]
                    held += sum(map(len, lines)) + len(lines) * (len(path) + 8)
                    if held >= PIECE:  # lines of many small files go together
                        yield batch()
                        paths, ats, texts, held = [], [], [], 0
        if texts:
            yield batch()


class GrowingLogs(DataSource):
    """Format `growing_logs`: (log_path, at, line) of the files below `path` whose names end with `suffix`."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "log_path string, at long, line string"

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def growing_lines(spark: SparkSession, root: str, run_id: str | None = None, range_bytes: int = RANGE, listings: str | None = None) -> DataFrame:
    """The lines table (as `ordered_lines` gives it) of logs below ``root``, as a stream.

    `pos` is the line's first byte and `block` the range that it lies in, so line order
    is the same in every batch. A file that shrinks ends the stream with an error.
    Offsets of many logs lie in ``listings``, which must stay as long as the stream's checkpoint.
    """
    spark.dataSource.register(GrowingLogs)
    options = {"path": root, "range_bytes": str(range_bytes), "tasks": str(spark.sparkContext.defaultParallelism), "listings": listings or fresh_folder(spark, "listings")}
    raw = spark.readStream.format("growing_logs").options(**options).load()
    lines = raw.select(
        "log_path", F.concat(F.lit(f"{root.rstrip('/')}/"), "log_path").alias("_full"),
        F.floor(F.col("at") / range_bytes).alias("block"), F.col("at").alias("pos"), "line",
    )
    return labelled(lines, run_id)


def append_lines(rows: DataFrame, root: str, first: str = "", last: str = "") -> None:
    """Appends (log_path, line) to files below ``root``: `first`, the lines, and `last` without a line feed.

    Rows of a file must be in one partition, side by side and in order; a row with a
    null line only names the file. A task that is run again would append again, so this
    is for logs made here, not for a sink.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = located(root)
        path, out = None, None

        def close() -> None:
            if out is not None:
                out.write(last.encode())
                out.close()

        for batch in batches:
            for name, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != path:
                    close()
                    path = name
                    files.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
                    out = files.open_append_stream(f"{top}/{name}")
                    out.write(first.encode())
                if line is not None:
                    out.write(line.encode() + b"\n")
        close()
        yield from ()

    rows.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()
