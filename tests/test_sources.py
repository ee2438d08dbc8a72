import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from sortie.operators import extract, samples, selectors
from sortie.sources import corpora, coverage_maps, logs, manifest, sinks, tables
from sortie.streaming import jobs


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_log_source_reads_in_order_and_keys_by_full_path(spark, tmp_path):
    body = "\n".join(f"line {i}" for i in range(5000)) + "\n"
    root = write(
        tmp_path / "12345678" / "logs",
        {
            "i-0a-echidna v1/a/x.log": body, "i-0a-echidna v1/b/x.log": "other\r\nsecond\n", "top.log": "no folder", "i-0b-medusa/Runner_Commands.log": "ignored",
            "i-0b-medusa/notes.txt": "x", "plain/y.log": b"bad \xff byte\n",
        },
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = logs.ordered_lines(spark, root)
        rows = lines.orderBy("log_path", "block", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = [r for r in rows if r.log_path == "i-0a-echidna v1/a/x.log"]
    assert [r.line for r in big] == [f"line {i}" for i in range(5000)]
    assert len({r.block for r in big}) > 1
    assert {(r.run_id, r.instance_id, r.tool, r.tool_label) for r in big} == {("12345678", "i-0a", "echidna", "echidna v1")}
    others = {r.log_path for r in rows} - {"i-0a-echidna v1/a/x.log"}
    assert others == {"i-0a-echidna v1/b/x.log", "plain/y.log"}
    assert {r.instance_id for r in rows if r.log_path == "plain/y.log"} == {"unknown"}
    tail = logs.tails(lines, 2).where("log_path LIKE '%/b/%'").orderBy("from_end").collect()
    assert [(r.line, r.lines) for r in tail] == [("second", 2), ("other", 2)]
    assert logs.ordered_lines(spark, root, exclude=["ECHIDNA"]).select("log_path").distinct().count() == 1


def test_small_blocks_do_not_change_events(spark, tmp_path):
    text = "".join(f"[2024-01-01 00:{m:02d}:{s:02d}] Test p{(m * 60 + s) % 97} falsified!\n" for m in range(20) for s in range(60))
    root = write(tmp_path, {"i-1-echidna/a.log": text, "i-2-echidna/b.log": text[:2000]})
    want = sorted(map(tuple, extract.extract_events(logs.ordered_lines(spark, root, "r")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted(map(tuple, extract.extract_events(logs.ordered_lines(spark, root, "r")).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len([g for g in got if g[1] == "i-1"]) == 97


def test_coverage_maps(spark, tmp_path):
    root = write(
        tmp_path,
        {
            "i-a-foundry__target-aave v4__seed-3/showmap/main__suite__t1/x/run.txt": "e1: 2\n\ne2:0\n e3 :1\n",
            "i-a-foundry__target-aave v4__seed-3/out/showmap/pr/run.txt": "e9:+5\n",
            "i-b-medusa/showmap/solo/run.txt": "e1:1\n", "i-c-echidna/showmap/bad/run.txt": "e1:1\nbroken\n", "i-c-echidna/showmap/none/run.txt": "e1:0\n",
            "i-c-echidna/showmap/loose.txt": "e1:1\n", "i-c-echidna/other/run.txt": "e1:1\n",
        },
    )
    trials, edges, rejects = coverage_maps.read_edges(spark, root, exclude=["medusa"])
    got = {(r.approach, r.suite_test, r.trial_id, r.edge) for r in edges.collect()}
    assert got == {("main", "suite__t1", "seed-3", "e1"), ("main", "suite__t1", "seed-3", "e3"), ("pr", None, "seed-3", "e9")}
    assert {r.target_label for r in trials.collect()} == {"aave_v4"}
    assert {(r.path.split("showmap/")[1], r.reason) for r in rejects.collect()} == {
        ("bad/run.txt", "malformed line"), ("none/run.txt", "empty coverage"), ("loose.txt", "missing approach directory"),
    }


TYPED = [
    {"call": {"tag": "SolCall", "contents": ["transfer", [{"tag": "AbiAddress", "contents": "0xaa"}, {"tag": "AbiUInt", "contents": [256, "7"]}]]}},
    {"call": {"tag": "SolCall", "contents": ["echidna_property", []]}},
    {"call": {"tag": "NoCall", "contents": []}},
    {"call": {"tag": "SolCall", "contents": ["arr", [{"tag": "AbiArrayDynamic", "contents": [{"tag": "AbiTupleType", "contents": [{"tag": "AbiUIntType", "contents": 8}, {"tag": "AbiBytesDynamicType"}]}]}]]}},
]
MAPPED = [{"call": {"SolCall": {"name": "transfer", "args": [{"Address": "0xaa"}, {"Uint": ["0x07", 256]}]}}}, {"call": {"SolCalldata": "0xA9059CBB00"}}]
MEDUSA = [{"call": {"data": "0xa9059cbb00aa", "dataAbiValues": {"methodSignature": "transfer(address,uint)"}}}, {"call": {"data": "0xdeadbeef", "dataAbiValues": {"methodSignature": "transfer(address,uint256)"}}}, {"call": {}}]
CALLDATA = [{"calldata": "0xa9059cbb" + "0" * 10}]


@pytest.mark.parametrize("way", ["files", "elements"])
def test_corpora_of_four_engines(spark, tmp_path, way):
    root = write(
        tmp_path,
        {
            "i-aa-echidna-v2/echidna/coverage/1.txt": json.dumps(TYPED), "i-aa-echidna-v2/echidna/coverage/2.txt": json.dumps(TYPED, indent=2),
            "i-aa-echidna-v2/echidna/coverage/3.txt": "{}", "I-BB-recon-v0/x/coverage/s.txt": json.dumps(MAPPED),
            "i-cc-medusa-v1/m/call_sequences/s.json": json.dumps(MEDUSA), "i-cc-medusa-v1/m/other/s.json": json.dumps(MEDUSA),
            "i-dd-foundry-git/f/worker0/corpus/s.json.gz": gzip.compress(json.dumps(CALLDATA).encode()), "i-ee-foundry-git/f/logs/s.json": "[]",
        },
    )
    if way == "files":
        out = selectors.analyze(corpora.read_artifacts(spark, root))
    else:
        out = selectors.analyze_elements(*corpora.read_elements(spark, root))
    inst = {r.engine: r for r in out["instances"].collect()}
    e = inst["echidna"]
    assert (e.artifact_files, e.sequences, e.duplicates, e.malformed, e.ignored, e.calls, e.status) == (3, 1, 1, 1, 1, 3, "partial")
    assert (inst["medusa"].calls, inst["medusa"].ignored, inst["medusa"].mismatches, inst["medusa"].status) == (2, 1, 1, "available")
    assert inst["recon-fuzzer"].instance_label == "I-BB-recon-v0" and inst["foundry"].status == "available"
    dist = {(r.engine, r.key): r for r in out["distribution"].collect()}
    for engine, n in (("echidna", 1), ("recon-fuzzer", 2), ("medusa", 1), ("foundry", 1)):
        row = dist[engine, "0xa9059cbb"]
        assert (row.calls, row.names, row.signatures) == (n, "transfer", "transfer(address,uint256)")
    assert dist["medusa", "0xdeadbeef"].names == ""
    assert "arr((uint8,bytes)[])" in {r.signatures for r in dist.values()}
    assert [(r.selector, r.families, r.name) for r in out["expected"].collect()] == [("0xa9059cbb", 3, "transfer")]
    assert out["missing"].count() == 0
    assert {(r.kind, r.severity) for r in out["health"].collect()} == {("malformed_artifact", "warning")}


def test_host_metrics(spark, tmp_path):
    head = "timestamp,uptime_seconds,load1,cpu_user_pct,cpu_system_pct,cpu_iowait_pct,mem_total_kb,mem_used_kb\n"
    stamp = "2026-01-01T00:00:{:02d}+00:00"
    rows = "".join(f"{stamp.format(20 * i)},{100 + i},0.1,{40 + 40 * i},10,1,1048576,{524288 * i}\n" for i in range(3))
    moved = "mem_used_kb,mem_total_kb,cpu_iowait_pct,cpu_system_pct,cpu_user_pct,uptime_seconds,timestamp\n524288,1048576,0,0,5,7,\n524288,1048576,0,,15,9,x\n"
    root = write(
        tmp_path,
        {"i-1-medusa/runner_metrics.csv": head + rows, "i-2-echidna/sub/runner-metrics-2.csv": moved, "i-3-medusa/runner_metrics.csv": "timestamp,x\n1,2\n", "i-3-medusa/other.csv": head + rows},
    )
    raw = tables.read_host_metrics(spark, root, "r")
    derived = samples.derive_host_metrics(raw, ["metrics_path"], "block", ["line_no"], budget_hours=0.01)
    got = {r.instance_id: r for r in samples.host_summary(derived).collect()}
    assert set(got) == {"i-1", "i-2"}
    one, two = got["i-1"], got["i-2"]
    assert (one.samples, one.duration_hours, one.cpu_active_peak_pct, one.mem_used_peak_gib) == (2, pytest.approx(20 / 3600), 91.0, 0.5)
    assert (two.samples, two.duration_hours, two.cpu_active_avg_pct, two.mem_used_avg_pct) == (2, pytest.approx(2 / 3600), 10.0, 50.0)
    late = samples.derive_host_metrics(raw, ["metrics_path"], "block", ["line_no"], budget_hours=0.0)
    assert late.groupBy("metrics_path").count().collect()[0]["count"] >= 1 and late.count() == 2


def test_event_tables(spark, tmp_path):
    root = write(tmp_path, {"a.csv": "run_id,fuzzer,event,elapsed_seconds\nr,medusa,e,1.5\nr,medusa,e,12d\nr,,f,nan\n", "b.csv": "run_id,instance_id,fuzzer,event,elapsed_seconds\nr,,m, e ,1\n"})
    lenient = tables.events_lenient(tables.read_csv(spark, f"{root}/a.csv")).collect()
    assert [(r.instance_id, r.tool_label, r.elapsed_seconds) for r in lenient] == [("unknown", "medusa", 1.5)]
    with pytest.raises(ValueError, match="missing columns: instance_id"):
        tables.events_strict(tables.read_csv(spark, f"{root}/a.csv"))
    with pytest.raises(ValueError, match="12d"):
        tables.events_strict(tables.read_csv(spark, f"{root}/a.csv").withColumn("instance_id", F.lit("i")))
    strict = tables.events_strict(tables.read_csv(spark, f"{root}/b.csv")).first()
    assert (strict.instance_id, strict.tool_label, strict.event) == ("unknown", "m", "e")
    raw = spark.createDataFrame([("m", "r", "i", "3600", "1"), ("m", "r", "i", "x", "-1")], "fuzzer string, run_id string, instance_id string, elapsed_seconds string, v string")
    assert [(r.series_id, r.time_hours) for r in tables.metric_samples(raw, ["v"]).collect()] == [("r:i", 1.0)]
    with pytest.raises(ValueError, match="malformed non-negative v"):
        tables.metric_samples(raw, ["v"], ["v"])
    with pytest.raises(ValueError, match="_run"):
        tables.wide_to_long(spark.createDataFrame([(1.0, 2)], "time_hours double, total int"))


def test_catalog_and_manifest_files(spark, tmp_path):
    entry = {"id": "b1", "title": "T", "kind": "historical-regression", "evidence": [{"url": "u", "description": "d"}], "aliases": [{"event": "x", "fuzzers": ["medusa", "echidna"]}]}
    catalog = {"schema_version": 1, "targets": [{"target_id": "t", "target_commit": "c", "notes": "n", "canaries": [dict(entry, id="c1")], "known_bugs": [entry]}]}
    root = write(
        tmp_path,
        {"cat.json": json.dumps(catalog, indent=1), "runs/a/manifest.json": json.dumps({"run_id": "a", "fuzzer_keys": ["x"], "preliminary": {"enabled": True, "interval_seconds": 60}}), "runs/b/manifest.json": "nope", "logs/manifest.json": "{}"},
    )
    flat = tables.read_catalog(spark, f"{root}/cat.json")
    assert {(r["class"], r.id, r.tool, r.kind) for r in flat["aliases"].collect()} == {
        (c, i, t, k) for c, i, k in (("canary", "c1", None), ("known_bug", "b1", "historical-regression")) for t in ("medusa", "echidna")
    }
    found = tables.read_run_manifests(spark, f"{root}/runs/*/manifest.json").collect()
    assert [(r.run_id, r.preliminary.interval_seconds) for r in found] == [("a", 60)]
    assert tables.find_run_manifest(spark, f"{root}/logs") == f"{root}/logs/manifest.json"
    assert tables.find_run_manifest(spark, f"{root}/none") is None
    with pytest.raises(FileNotFoundError):
        tables.find_run_manifest(spark, f"{root}/logs", f"{root}/nothing.json")
    before = manifest.content_manifest(spark, root)
    assert before.count() == 4 and manifest.totals(before).first().files == 4
    write(tmp_path, {"logs/manifest.json": "{ }", "new.txt": "x"})
    assert {(r.path, r.change) for r in manifest.changes(before, before.where("path <> 'cat.json'")).collect()} == {("cat.json", "removed")}


def test_sinks_replace_only_their_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    assert sinks.counted_write(rows, path, "first") == {"first": 2}
    sinks.write_table(spark.createDataFrame([("r2", 5)], "run_id string, v int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("run_id", "v").collect())) == [("r1", 1), ("r2", 5)]
    sinks.export(rows.withColumn("a", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "csv"))
    assert {r.a for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"x;y"}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [("m", "m", "r", f"i{rng.randrange(3)}", f"e{rng.randrange(6)}", float(t)) for t in range(60)]
    cols = "tool string, tool_label string, run_id string, instance_id string, event string, elapsed_seconds double"
    folder = str(tmp_path / "in")
    for at in range(0, 60, 20):
        spark.createDataFrame(rows[at : at + 20], cols).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, spark.read.parquet(folder).schema, per_batch=1)
    keys = ["tool", "tool_label", "run_id", "instance_id", "event"]
    got = jobs.drain_update(jobs.running_first_times(stream), "t", keys)
    want = spark.createDataFrame(rows, cols).groupBy(keys).agg(F.min("elapsed_seconds").alias("elapsed_seconds"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    timed = stream.withColumn("event_time", F.timestamp_seconds(F.col("elapsed_seconds")))
    seen = jobs.drain_append(jobs.first_seen(timed, keys), "s")
    assert seen.count() == want.count() == seen.distinct().count()


def test_publish_once(spark, tmp_path):
    target, keys = str(tmp_path / "pub"), ["checkpoint", "run_id"]
    publish = jobs.publish_once(target, keys)
    schema = "run_id string, checkpoint int, v int"
    shown = lambda: sorted(map(tuple, jobs.published(spark, target, keys).select("run_id", "checkpoint", "v").collect()))
    publish(spark.createDataFrame([("r", 1, 10), ("r", 1, 11)], schema), 0)
    publish(spark.createDataFrame([("r", 1, 99), ("r", 2, 20)], schema), 1)
    assert shown() == [("r", 1, 10), ("r", 1, 11), ("r", 2, 20)]
    # a batch that died between its rows and its commit is not seen, and its retry is
    late = spark.createDataFrame([("r", 3, 30), ("s", 1, 40)], schema)
    late.write.parquet(f"{target}/rows/attempt=000000000002-dead")
    assert len(shown()) == 3
    publish(late, 2)
    publish(late, 2)
    publish(late.limit(0), 3)
    assert shown() == [("r", 1, 10), ("r", 1, 11), ("r", 2, 20), ("r", 3, 30), ("s", 1, 40)]
    # two batches that commit a key at a time: the lower attempt shows
    late.write.parquet(f"{target}/rows/attempt=000000000000-other")
    late.select(*keys).withColumn("attempt", F.lit("000000000000-other")).write.mode("append").parquet(f"{target}/commits")
    assert len(shown()) == 5


def test_silent_runs_come_once_and_only_when_due(spark, tmp_path):
    schema = "run_id string, due_at timestamp, event_time timestamp"
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        both = jobs.file_stream(spark, feed, schema)
        starts = both.where("due_at IS NOT NULL").select("run_id", "due_at")
        signs = both.where("event_time IS NOT NULL").select("run_id", "event_time")
        rows = jobs.drain_append(jobs.silent_runs(starts, signs, ["run_id"], 1800), "silent", out).collect()
        return sorted((r.run_id, r.silent_at) for r in rows)

    assert batch([("mute", at(0), None), ("late", at(1), None), ("fine", at(0), None), ("fine", None, at(10))]) == []
    assert batch([("late", None, at(29)), ("other", at(33), None), ("x", None, at(33))]) == []  # not yet past the settle delay
    assert batch([("later", at(60), None), ("x", None, at(60))]) == [("mute", at(30))]
    assert batch([("last", at(200), None), ("x", None, at(200))]) == [("later", at(90)), ("mute", at(30)), ("other", at(63))]


def test_complete_records_drop_the_partial_tail(spark):
    df = spark.createDataFrame([("a", "x\ny\npart"), ("b", "none"), ("c", "x\n\n"), ("d", "")], "p string, content string")
    assert [(r.p, r.pos, r.line) for r in jobs.complete_records(df).orderBy("p", "pos").collect()] == [("a", 0, "x"), ("a", 1, "y"), ("c", 0, "x"), ("c", 1, "")]


def test_calls_without_a_name_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    from sortie.operators import selectors

    rows = [("r1", f"i{i}", "e", "t", "t-v1", f"0x{i % 50:08x}", None, None if i % 4 else f"n{i % 50}", "f", 1) for i in range(4000)]
    counts = spark.createDataFrame(rows, "run_id string, instance_label string, engine string, tool string, tool_label string, selector string, signature string, name string, source_format string, n long")
    known = spark.createDataFrame([(f"n{i}", i) for i in range(0, 50, 4)], "_name string, at int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = selectors.looked_up(counts, "name", known, "_name")
        assert found.columns == [*counts.columns, "_name", "at"] and found.count() == 4000
        assert found.where("name is null and _name is not null").count() == 0
        assert sorted(x.n for x in found.where("_name is not null").groupBy("name").agg(F.count("*").alias("n")).collect()) == sorted(sum(1 for x in rows if x[7] == f"n{i}") for i in range(0, 50, 4) if any(x[7] == f"n{i}" for x in rows))
        tasks = found.where("name is null").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 4 and max(x["count"] for x in tasks) < 1500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_runs_are_dealt_to_tasks_of_bounded_size(spark):
    from sortie.plans import q_runs

    dealt = q_runs._by_run(spark.range(1000).selectExpr("cast(id as string) as run_id"), 1_000_001)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 1000
