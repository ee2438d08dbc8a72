import json
import random

from sortie.operators import extract, signals


def events_of(df):
    return sorted((r.log_path, r.event, round(r.elapsed_seconds, 6), r.source) for r in df.collect())


def pulse(t, **metrics):
    return json.dumps({"timestamp": t, "event": "pulse", "metrics": metrics})


def failure(t, name):
    return json.dumps({"timestamp": t, "event": "failure", "invariant": name, "target": "Harness"})


def summary(name):
    return f"[FAIL: assertion failed] test/a.sol:Harness::{name}"


def test_json_logs(spark, as_lines):
    lines = as_lines(
        {
            ("promote", "foundry"): [
                pulse(100, unique_failures=0, broken_handlers=0), failure(101, "inv_a"), pulse(102, unique_failures=1, broken_handlers=2),
                failure(103, "inv_b"), pulse(104, unique_failures=2, broken_handlers=3),
            ],
            ("named_late", "foundry"): [
                pulse(100, broken_invariants=0, broken_assertions=0), pulse(130, broken_invariants=0, broken_assertions=1),
                pulse(200, broken_invariants=0, broken_assertions=2), summary("first"), summary("second"),
            ],
            ("no_counter", "foundry"): [pulse(100, cumulative_edges_seen=1), pulse(160, cumulative_edges_seen=2), summary("only")],
            ("repeated", "foundry"): [pulse(100, broken_invariants=0, broken_assertions=1), summary("x"), summary("x")],
            ("text", "foundry"): [
                "fuzz: elapsed: 6s, calls: 1", "[FAIL: broken] inv_pool() (runs: 2)", "[FAIL: ] inv_bare", "test_thing(): FAIL",
                '{"timestamp": broken', json.dumps({"event": "failure", "invariant": "no_timestamp"}),
            ],
            ("selector", "foundry"): [
                json.dumps({"timestamp": 5, "event": "failure", "failure_type": "handler_assertion", "selector": "0xF24A44C9"}),
                json.dumps({"timestamp": 9, "event": "failure", "failure_type": "handler_assertion", "selector": "0x00000000"}),
                json.dumps({"timestamp": 11, "type": "invariant_failure", "invariant": "C:legacy"}),
            ],
        }
    )
    metric, late = "foundry-broken-handler-metric", "foundry-handler-summary"
    assert events_of(extract.json_events(lines)) == sorted(
        [
            ("promote.log", "inv_a", 1.0, "foundry-failure-event"), ("promote.log", "foundry_handler_bug_1", 2.0, metric),
            ("promote.log", "foundry_handler_bug_2", 2.0, metric), ("promote.log", "inv_b", 3.0, "foundry-failure-event"),
            ("promote.log", "foundry_handler_bug_3", 4.0, metric),
            ("named_late.log", "first", 30.0, late), ("named_late.log", "second", 100.0, late),
            ("no_counter.log", "only", 60.0, late), ("repeated.log", "x", 0.0, late),
            ("text.log", "inv_pool", 6.0, "foundry-text-failure"), ("text.log", "inv_bare", 6.0, "foundry-text-failure"),
            ("text.log", "test_thing", 6.0, "foundry-text-failure"),
            ("selector.log", "assert_canary_ASSERTION_CANARY", 0.0, "foundry-handler-selector"),
            ("selector.log", "legacy", 6.0, "foundry-invariant-failure"),
        ]
    )


def test_counters_and_late_names_match_a_reader_with_a_queue(spark, as_lines):
    """Random logs: the window form against a sequential model."""
    rng = random.Random(11)
    files, want = {}, []
    for f in range(150):
        lines, seen, queue, events, made = [], set(), [], [], 0
        for t in range(rng.randrange(1, 14)):
            kind = rng.random()
            if kind < 0.35:
                name = f"n{rng.randrange(4)}"
                lines.append(failure(1000 + t, name))
                if name not in seen:
                    seen.add(name)
                    events.append([name, float(t)])
            elif kind < 0.7:
                a, b = rng.randrange(4), rng.randrange(5)
                lines.append(pulse(1000 + t, unique_failures=a, broken_assertions=b))
                for _ in range(max(0, a + b - len(seen))):
                    made += 1
                    seen.add(f"foundry_handler_bug_{made}")
                    events.append([f"foundry_handler_bug_{made}", float(t)])
                    queue.append(events[-1])
            else:
                name = f"h{rng.randrange(5)}"
                lines.append(summary(name))
                if name not in seen:
                    seen.add(name)
                    if queue:
                        queue.pop(0)[0] = name
                    else:
                        events.append([name, None])
        lines.insert(0, pulse(1000, other=1))  # the clock starts at 1000 in every file
        files[f"f{f}", "foundry"] = lines
        want += [(f"f{f}.log", n, t) for n, t in events]
    got = extract.json_events(as_lines(files, per_block=3)).collect()
    timed = {(p, n) for p, n, t in want if t is None}
    a = sorted((r.log_path, r.event, None if (r.log_path, r.event) in timed else r.elapsed_seconds) for r in got)
    assert [x[:2] for x in a] == [x[:2] for x in sorted(want, key=lambda x: (x[0], x[1]))]
    assert {x for x in a if x[2] is not None} == {x for x in want if x[2] is not None}


def test_timestamp_and_elapsed_logs(spark, as_lines):
    ts = "[2026-02-24 14:35:{:05.2f}] "
    lines = {
        ("generic", "other"): ["early !!! lost", ts.format(10) + "start", ts.format(12.5) + 'call !!! bug_a" x', "!!! bug_a", "panic: assertion failed", ts.format(20) + "FAILURE again"],
        ("ech", "echidna"): [ts.format(1) + "go", ts.format(4) + "Test \x1b[1mp1\x1b[0m falsified!", "p2(uint256): failed!", "x !!! y"],
        ("rec", "recon-fuzzer"): [ts.format(1) + "go", "p2(uint256): failed!", ts.format(3) + "Test p2 falsified!"],
        ("med", "medusa"): ["!!! before clock", "fuzz: elapsed: 1m5s", "[FAILED] Assertion Test: A.f(uint256)", "!!! raw", "elapsed: 70s", "[FAILED] Property Test: A.g()", "panic: assertion failed"],
    }
    assert events_of(extract.extract_events(as_lines(lines))) == sorted(
        [
            ("generic.log", "bug_a", 2.5, "bang"), ("generic.log", "assertion_failed", 2.5, "panic"), ("ech.log", "p1", 3.0, "falsified"),
            ("rec.log", "p2", 0.0, "failed"), ("med.log", "A.f(uint256)", 65.0, "medusa-failed"), ("med.log", "A.g()", 70.0, "medusa-failed"),
        ]
    )


STATUS = "fuzz: elapsed: 1m8s, calls: 900 (30/sec), seq/s: 7, branches hit: 55, corpus: 12, failures: 2/80, gas/s: 123456"


def test_throughput(spark, as_lines):
    ts = "[2031-05-06 07:08:{}] [status] tests: 1/2, fuzzing: {}/800, cov: 66, corpus: 3, gas/s: {}"
    lines = as_lines(
        {
            ("m", "medusa"): [STATUS],
            ("e", "echidna"): [ts.format("20.50", 100, 2000), ts.format("24.50", 500, 3000)],
            ("bad", "foundry"): [
                '{"timestamp":100,"tps":"nan","gps":"inf"}', '{"timestamp":105,"tps":-1,"gps":-2}', '{"timestamp":110,"total_txs":%s}' % ("9" * 400),
                '{"timestamp":115,"tps":0,"gps":0}', '{"timestamp":broken',
            ],
            ("reset", "foundry"): ['{"timestamp":100,"total_txs":100,"tps":10,"gps":1000}', '{"timestamp":105,"total_txs":5,"tps":1,"gps":100}', '{"timestamp":105,"total_txs":6,"tps":1,"gps":100}'],
            ("quiet", "foundry"): ['{"timestamp":1,"metrics":{"cumulative_edges_seen":21,"corpus_count":5,"favored_items":4}}', "No files changed"],
            ("total", "foundry"): ['{"timestamp":100,"x":1}', '{"timestamp":110,"metrics":{"total_calls":50}}'],
        }
    )
    got = {}
    for r in signals.throughput_samples(lines).orderBy("log_path", "pos").collect():
        got.setdefault(r.log_path, []).append((round(r.elapsed_seconds, 2), r.tx_per_second and round(r.tx_per_second, 4), r.gas_per_second, r.source))
    assert got["m.log"] == [(68.0, 30.0, 123456.0, "text-rate")]
    assert got["e.log"] == [(0.0, None, 2000.0, "text-rate"), (4.0, 100.0, 3000.0, "text-interval")]
    assert got["bad.log"] == [(15.0, 0.0, 0.0, "json-rate")]
    assert got["reset.log"] == [(0.0, 10.0, 1000.0, "json-rate"), (5.0, 1.0, 100.0, "json-rate")]
    assert got["total.log"] == [(10.0, 5.0, None, "json-cumulative")]
    assert "quiet.log" not in got


def test_progress(spark, as_lines):
    lines = as_lines(
        {
            ("m", "medusa"): [STATUS],
            ("f", "foundry"): ['{"timestamp":10,"metrics":{"cumulative_edges_seen":21,"corpus_count":5,"favored_items":4,"failed_current":1,"failed_total":4}}', '{"timestamp":10,"metrics":{"cumulative_edges_seen":21,"corpus_count":5,"favored_items":4,"failed_current":1,"failed_total":4}}'],
            ("o", "other"): ["elapsed: 3s failures: 1/4", "elapsed: 4s failures: 5/4"],
        }
    )
    rows = {r.log_path: r for r in signals.progress_samples(lines, coverage=True).collect()}
    m = rows["m.log"]
    assert (m.elapsed_seconds, m.seq_per_second, m.coverage_proxy, m.corpus_size, m.favored_items, m.failure_rate, m.source) == (68.0, 7.0, 55.0, 12.0, None, None, "text-metrics:branches_hit")
    f = rows["f.log"]
    assert (f.coverage_proxy, f.corpus_size, f.favored_items, f.failure_rate, f.source) == (21.0, 5.0, 4.0, 0.25, "json-metrics:cumulative_edges_seen")
    assert (rows["o.log"].elapsed_seconds, rows["o.log"].failure_rate) == (3.0, 0.25)
    assert len(rows) == 3
    plain = {r.log_path: r.source for r in signals.progress_samples(lines).collect()}
    assert plain["m.log"] == "text-metrics"
