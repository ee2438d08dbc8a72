"""Failures of a growing log: any cut into micro-batches settles to the batch result."""

import json
import random

from sortie.operators import extract
from sortie.session import fresh_folder
from sortie.streaming import jobs, reconcile

SCHEMA = "run_id string, instance_id string, tool string, tool_label string, log_path string, block long, pos long, line string"


def random_line(rng, clock):
    kind = rng.randrange(8)
    ts = {"timestamp": clock}
    if kind == 0:
        return json.dumps(ts | {"event": "failure", "target": "T", "invariant": f"C:{rng.choice('abc')}"})
    if kind in (1, 2):
        return json.dumps(ts | {"metrics": {"unique_failures": rng.randrange(5), "broken_assertions": rng.randrange(4)}})
    if kind in (3, 4):
        return f"[FAIL: assertion failed] src/a.sol:Ctr::late_{rng.randrange(9)}"
    if kind == 5:
        return f"[FAIL: reverted] {rng.choice('xyz')}() (runs: 1)"
    return rng.choice(["noise", f"elapsed: {rng.randrange(99)}s", json.dumps(ts)])


def test_any_cut_settles_to_the_batch_result(spark):
    rng, rows = random.Random(21), []
    for f in range(12):
        clock = rng.choice([0, 1000])
        for i in range(rng.randrange(5, 60)):
            clock += rng.randrange(3)
            rows.append(("r", f"i-{f}", "foundry", "foundry", f"{f}.log", i // 7, i, random_line(rng, clock)))
    key = lambda r: (r.log_path, r.event, round(r.elapsed_seconds, 9), r.source)
    want = sorted(map(key, extract.json_events(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert any("foundry_handler_bug_" in w[1] for w in want) and any(w[3] == reconcile.LATE for w in want)
    # lines of a file arrive in order, each file with its own pace
    cuts = {f"{f}.log": sorted(rng.randrange(61) for _ in range(2)) for f in range(12)}
    folder, out = fresh_folder(spark, "feed"), fresh_folder(spark, "updates")
    for part in range(3):
        now = [r for r in rows if sum(r[6] >= c for c in cuts[r[4]]) == part]
        spark.createDataFrame(rng.sample(now, len(now)), SCHEMA).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
        updates = jobs.drain_append(reconcile.live_failures(stream), "live", out)
    assert sorted(map(key, reconcile.settled(updates).collect())) == want
    versions = {r["count"] for r in updates.groupBy("log_path", "key").count().collect()}
    assert versions == {1, 2}  # late names are corrections of rows that were out already


def test_a_file_read_line_by_line(spark):
    reader = reconcile.Reader()
    take = lambda **kw: list(reader.take(*[kw.get(k) for k in ("ts", "text_clock", "expected", "name", "source")]))
    assert take(ts=100.0) == [] and take(ts=105.0, expected=2) == [("#1", 0, "foundry_handler_bug_1", 5.0, reconcile.IMPLIED), ("#2", 0, "foundry_handler_bug_2", 5.0, reconcile.IMPLIED)]
    reader = reconcile.Reader(reader.saved())
    assert take(name="late", source=reconcile.LATE) == [("#1", 1, "late", 5.0, reconcile.LATE)]
    assert take(name="late", source=reconcile.LATE) == [] and take(ts=110.0, expected=3) == []
    assert take(ts=111.0, name="own", source="foundry-failure-event") == [("=own", 0, "own", 11.0, "foundry-failure-event")]
    assert take(name="two", source=reconcile.LATE)[0][0] == "#2" and take(name="three", source=reconcile.LATE) == [("=three", 0, "three", 11.0, reconcile.LATE)]
