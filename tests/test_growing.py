"""Logs that grow between, and inside, micro-batches."""

import io
import json
import pickle
import random
import tracemalloc

import pytest
from pyarrow import fs

from sortie.session import fresh_folder
from sortie.streaming import growing, jobs


def drained(spark, root, out, range_bytes=1 << 16):
    return jobs.drain_append(growing.growing_lines(spark, str(root), "r", range_bytes), "seen", out)


def test_any_cut_into_ranges_gives_each_line_once(monkeypatch):
    monkeypatch.setattr(growing, "PIECE", 7)
    rng = random.Random(6)
    for _ in range(200):
        data = b"".join(rng.choice([b"", b"a", b"bb\r", b"c" * 20, "é".encode()]) + b"\n" for _ in range(rng.randrange(12))) + rng.choice([b"", b"tail"])
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(4))
        got = []
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            for places, lines in growing.lines_of(io.BytesIO(data), a, b) if a < b else ():
                got += zip(places, lines)
        want, at = [], 0
        for line in data.split(b"\n")[:-1]:
            want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        assert got == want


def test_appending_between_batches_yields_each_complete_line_once(spark, tmp_path):
    out, log = fresh_folder(spark, "grown"), tmp_path / "i-0a-echidna" / "echidna.log"
    log.parent.mkdir()
    log.write_bytes("one\ntwö\npart".encode())
    assert sorted(r.line for r in drained(spark, tmp_path, out).collect()) == ["one", "twö"]
    with log.open("ab") as more:
        more.write(b"ial\n" + b"x" * 300)
    (tmp_path / "i-1b-medusa").mkdir()
    (tmp_path / "i-1b-medusa" / "m.log").write_bytes(b"\n\nlast\n")
    (tmp_path / "i-1b-medusa" / "notes.txt").write_bytes(b"no log\n")
    # a restart with smaller ranges goes on where the first query ended
    rows = drained(spark, tmp_path, out, 64).collect()
    assert sorted(r.line for r in rows) == ["", "", "last", "one", "partial", "twö"]
    by = sorted((r.block, r.pos, r.line) for r in rows if r.log_path == "i-0a-echidna/echidna.log")
    assert [x[2] for x in by] == ["one", "twö", "partial"]
    with log.open("ab") as more:
        more.write(b"y\n")
    assert ("x" * 300 + "y") in {r.line for r in drained(spark, tmp_path, out, 64).collect()}
    assert drained(spark, tmp_path, out).count() == 7  # nothing new


def test_a_log_that_shrinks_is_an_error(spark, tmp_path):
    out, log = fresh_folder(spark, "shrunk"), tmp_path / "i-0a-echidna" / "echidna.log"
    log.parent.mkdir()
    log.write_bytes(b"one\ntwo\n")
    drained(spark, tmp_path, out)
    log.write_bytes(b"one\n")
    with pytest.raises(Exception, match="shrank"):
        drained(spark, tmp_path, out)
    with pytest.raises(ValueError, match="shrank"):
        list(growing.lines_of(io.BytesIO(b"ab\n"), 0, 9))


def test_many_small_logs_share_tasks_and_batches(tmp_path):
    """A task costs far more than a small log: many logs make few tasks and batches, few are dealt over the tasks."""
    for i in range(300):
        (tmp_path / f"{i:03}.log").write_bytes(b"one\n" * 40 + b"part")
    reader = growing.Reader({"path": str(tmp_path), "tasks": "4"})
    first = reader.latestOffset()
    dealt = reader.partitions({}, first)
    assert 4 <= len(dealt) <= 6 and max(len(x.parts) for x in dealt) <= 80
    many = {f"{i:05}.log": 200 for i in range(20_000)}
    assert len(reader.partitions({}, many)) < 40
    for i in range(300):
        with (tmp_path / f"{i:03}.log").open("ab") as more:
            more.write(b"ial\ntwo\n")
    got = []
    for x in dealt + reader.partitions(first, reader.latestOffset()):
        batches = list(reader.read(x))
        assert len(batches) == 1
        got += [(r["log_path"], r["at"], r["line"]) for r in batches[0].to_pylist()]
    want = [(f"{i:03}.log", at, line) for i in range(300) for at, line in [*((4 * k, "one") for k in range(40)), (160, "partial"), (168, "two")]]
    assert sorted(got) == want


def test_offsets_and_partitions_of_many_logs_name_files(tmp_path, monkeypatch):
    """What the driver holds of many logs does not grow with them, and each line still comes once."""
    monkeypatch.setattr(growing, "SORTED", 64)
    monkeypatch.setattr(growing, "LISTED", 7)
    logs, lists = tmp_path / "logs", tmp_path / "lists"
    for i in range(300):
        (logs / f"i-{i}").mkdir(parents=True)
        (logs / f"i-{i}" / "é.log").write_bytes(b"one\n" * (i % 5) + b"part")
    reader = growing.Reader({"path": str(logs), "tasks": "4", "listings": str(lists), "inline": "20"})
    first = reader.latestOffset()
    assert reader.latestOffset() == first and first["logs"] == 300
    dealt = reader.partitions({}, first)
    for x in [first, *dealt]:
        assert len(json.dumps(x) if isinstance(x, dict) else pickle.dumps(x)) < 500
    assert len(dealt) >= 4
    held = {f"i-{i}/é.log": 4 * (i % 5) + 4 for i in range(300)}
    assert list(reader._sizes(first)) == sorted(held.items())
    assert [reader._parts(x) for x in dealt] == [x.parts for x in growing.Reader({"path": str(logs), "tasks": "4"}).partitions({}, held)]
    for i in range(0, 300, 2):
        with (logs / f"i-{i}" / "é.log").open("ab") as more:
            more.write(b"ial\ntwo\n")
    (logs / "i-07").mkdir()
    (logs / "i-07" / "new.log").write_bytes(b"new\n")
    second = reader.latestOffset()
    later = reader.partitions(first, second)
    again = reader.partitions(held, second)  # a start as offsets of few logs, and older streams, have it
    assert [reader._parts(x) for x in later] == [reader._parts(x) for x in again]
    got = [(r["log_path"], r["at"], r["line"]) for x in dealt + later for b in reader.read(x) for r in b.to_pylist()]
    want = [(f"i-{i}/é.log", 4 * k, "one") for i in range(300) for k in range(i % 5)] + [("i-07/new.log", 0, "new")]
    want += [(f"i-{i}/é.log", 4 * (i % 5) + at, line) for i in range(0, 300, 2) for at, line in ((0, "partial"), (8, "two"))]
    assert sorted(got) == sorted(want)
    reader.commit(second)  # the start and its plan are over, what begins at `second` is not
    assert first["listing"].split("/")[-1] not in {x.name for x in lists.iterdir()}
    assert reader.partitions(second, reader.latestOffset()) == []
    (logs / "i-299" / "é.log").write_bytes(b"")
    with pytest.raises(ValueError, match="shrank"):
        reader.partitions(second, reader.latestOffset())


def test_sizes_of_logs_pass_the_driver_a_few_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "SORTED", 2000)
    monkeypatch.setattr(growing, "LISTED", 100)
    monkeypatch.setattr(growing, "files_below", lambda files, top: ((f"{top}/i-{i * 7919 % 100_000:06}/tool.log", 100) for i in range(100_000)))
    reader = growing.Reader({"path": "/logs", "tasks": "4", "listings": str(tmp_path)})
    tracemalloc.start()
    try:
        offset = reader.latestOffset()
        dealt = reader.partitions({}, offset)
        assert tracemalloc.get_traced_memory()[1] < 6_000_000
    finally:
        tracemalloc.stop()
    assert offset["logs"] == sum(len(reader._parts(x)) for x in dealt) == 100_000


def test_folders_are_listed_alike_on_a_disk_and_in_a_store(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "FOLDERS", 3)
    for name in ("a/b/c/x.log", "a/y.log", "d/z.log", "w.log", *(f"e/{i}/v.log" for i in range(9))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "gone.log").symlink_to(tmp_path / "nowhere")
    here = sorted(growing.files_below(fs.LocalFileSystem(), str(tmp_path)))
    assert len(here) == 13 and (f"{tmp_path}/a/y.log", 7) in here
    store = fs.SubTreeFileSystem(str(tmp_path.parent), fs.LocalFileSystem())
    assert sorted((f"{tmp_path.parent}/{path}", size) for path, size in growing.files_below(store, tmp_path.name)) == here
    assert list(growing.files_below(fs.LocalFileSystem(), str(tmp_path / "none"))) == list(growing.files_below(store, "none")) == []


def test_a_stream_goes_on_when_its_logs_become_many(spark, tmp_path):
    out, logs = fresh_folder(spark, "many"), tmp_path / "logs"

    def drained():
        spark.dataSource.register(growing.GrowingLogs)
        options = {"path": str(logs), "tasks": "2", "listings": fresh_folder(spark, "lists"), "inline": "3"}
        return sorted(r.line for r in jobs.drain_append(spark.readStream.format("growing_logs").options(**options).load(), "seen", out).collect())

    def add(i, data):
        (logs / f"i-{i}").mkdir(parents=True, exist_ok=True)
        with (logs / f"i-{i}" / "t.log").open("ab") as log:
            log.write(data)

    for i in range(3):
        add(i, b"one\npart")
    assert drained() == ["one"] * 3
    for i in range(9):
        add(i, b"ial\nx")
    assert drained() == sorted(["one"] * 3 + ["partial"] * 3 + ["ial"] * 6)
    assert len(drained()) == 12  # nothing new, listed elsewhere
    add(8, b"\n")
    assert drained().count("x") == 1
