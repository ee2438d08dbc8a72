"""Scalar rules over whole tables: texts are built from the rows, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scalars as S
from .registry import query
from .views import base_events, table, v_events, with_views


def _ev(spark, d):
    return base_events(spark, d)


def _s(col):
    return F.col(col).cast("string")


def _pick(n, *choices):
    """Text by K modulo n; the last choice is the rest."""
    out = F.when(F.col("k") % n == 0, choices[0])
    for i, c in enumerate(choices[1:-1], 1):
        out = out.when(F.col("k") % n == i, c)
    return out.otherwise(choices[-1])


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


_B = "b_events"


@query("P1", with_views(_B, """SELECT event_id, CASE k % 4 WHEN 0 THEN k * 3600 + user_id % 60 * 60 + event_id % 60 WHEN 1 THEN event_id % 1000 WHEN 2 THEN 2 * k * 60 END AS seconds FROM b_events"""))
def duration_text(spark, d):
    text = _pick(
        4, _cat(_s("k"), "h", (F.col("user_id") % 60).cast("string"), "m", (F.col("event_id") % 60).cast("string"), "s"),
        _cat((F.col("event_id") % 1000).cast("string"), "s"), _cat(_s("k"), "m", _s("k"), "m"), F.lit("soon"),
    )
    return _ev(spark, d).select("event_id", S.duration_seconds(text).alias("seconds"))


@query("P2", with_views(_B, "SELECT event_id, CASE k % 3 WHEN 0 THEN us / 1e6 WHEN 1 THEN (us // 1000000) / 1e0 END AS epoch FROM b_events"))
def bracketed_timestamps(spark, d):
    ts = F.col("ts").cast("timestamp")
    line = _pick(
        3, _cat("[", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "] x"), _cat("[", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "] y"),
        _cat("[2024-13-45 10:00:00] z"),
    )
    return _ev(spark, d).select("event_id", S.prefix_epoch(line).alias("epoch"))


@query(
    "P3 P30",
    with_views(_B, """SELECT event_id, CASE WHEN k % 10 = 0 THEN 'unknown' ELSE 'i-' || lower(to_hex(user_id)) END AS instance_id,
       CASE WHEN k % 10 = 0 THEN 'x-' || event_type ELSE event_type || '-v1' END AS tool_label,
       CASE WHEN k % 10 = 0 THEN 'x-' || event_type ELSE event_type || '-v1' END AS tool FROM b_events"""),
)
def instance_labels(spark, d):
    label = F.when(F.col("k") % 10 == 0, _cat("x-", F.col("event_type"))).otherwise(
        _cat("i-", F.lower(F.hex("user_id")), "-", F.col("event_type"), "-v1")
    )
    rows = _ev(spark, d).select("event_id", S.instance_id(label).alias("instance_id"), S.tool_label(label).alias("tool_label"))
    return rows.withColumn("tool", F.col("tool_label"))


@query("P4", with_views(_B, "SELECT event_id, CASE k % 3 WHEN 0 THEN CAST(event_id + 10000000 AS VARCHAR) WHEN 1 THEN 'gh-' || k || '-2' END AS run_id FROM b_events"))
def run_ids_from_paths(spark, d):
    part = _pick(3, (F.col("event_id") + 10_000_000).cast("string"), _cat("gh-", _s("k"), "-2"), _cat("run", _s("k"), "/1234567"))
    return _ev(spark, d).select("event_id", S.run_id_from_path(_cat("/data/", part, "/logs/20240101x")).alias("run_id"))


@query(
    "P5",
    with_views(_B, "SELECT event_id, CASE k % 5 WHEN 0 THEN 'recon-fuzzer' WHEN 1 THEN 'echidna' WHEN 2 THEN 'medusa' WHEN 3 THEN 'foundry' ELSE 'my-echidna-' || event_type END AS tool FROM b_events"),
)
def normalized_tools(spark, d):
    label = _pick(5, _cat("Foundry-Recon-", _s("k")), _cat("Echidna-", _s("k")), _cat("my-MEDUSA-", _s("k")), _cat("git-foundry-", _s("k")), _cat("my-echidna-", F.col("event_type")))
    return _ev(spark, d).select("event_id", S.normalize_tool(label).alias("tool"))


@query(
    "P8",
    with_views(_B, "SELECT event_id, CASE WHEN k % 5 < 4 THEN value END AS tx, CASE WHEN k % 5 = 4 THEN CAST(k AS DOUBLE) END AS gas, CASE WHEN k % 5 = 3 THEN CAST(event_id AS DOUBLE) END AS n FROM b_events"),
)
def rates_from_text(spark, d):
    v = _s("value")
    line = _pick(
        5, _cat("status tx/s: ", v), _cat("at ", v, " transactions/sec now"), _cat("calls: 61658 (", v, "/sec), seq"),
        _cat("fuzzing: ", _s("event_id"), "/50000 calls per second = ", v), _cat("gas/s: ", _s("k")),
    )
    rows = _ev(spark, d).withColumn("line", line)
    return rows.select(
        "event_id", S.first_number("line", fixed.TX_RATE_TEXT).alias("tx"), S.first_number("line", fixed.GAS_RATE_TEXT).alias("gas"),
        S.first_number("line", fixed.TX_COUNT_TEXT).alias("n"),
    )


@query(
    "P9",
    with_views(_B, "SELECT event_id, CASE WHEN k >= 50 THEN k - 50 END AS nonneg, CASE WHEN k <= 80 THEN k / 80.0::DOUBLE END AS rate, CASE WHEN k % 7 <> 0 AND k >= 50 THEN CAST(k - 50 AS DOUBLE) END AS counter FROM b_events"),
)
def validity_guards(spark, d):
    shifted = F.col("k") - 50
    odd = F.when(F.col("k") % 7 == 0, F.lit(float("nan"))).otherwise(shifted.cast("double"))
    return _ev(spark, d).select(
        "event_id", S.nonnegative(shifted).alias("nonneg"), S.unit_rate(F.col("k") / 80.0).alias("rate"), S.coverage_counter(odd).alias("counter")
    )


@query(
    "P10",
    with_views(_B, "SELECT event_id, CASE WHEN k % 4 <> 0 AND user_id % 50 > 0 AND k <= user_id % 50 THEN k / (user_id % 50) END AS failure_rate FROM b_events"),
)
def failure_ratios(spark, d):
    line = _cat("corpus: 5, failures: ", _s("k"), "/", (F.col("user_id") % 50).cast("string"), ", x")
    tool = F.when(F.col("k") % 4 == 0, "medusa").otherwise("echidna")
    return _ev(spark, d).select("event_id", S.failure_ratio(line, tool).alias("failure_rate"))


@query(
    "P11",
    with_views(
        _B,
        """SELECT event_id, CASE k % 5 WHEN 0 THEN 'cov' WHEN 1 THEN 'branches_hit' WHEN 3 THEN 'unique_instructions' END AS text_signal,
           CASE WHEN k % 5 IN (0, 1, 3) THEN CAST(event_id AS DOUBLE) END AS text_value,
           CASE k % 5 WHEN 0 THEN 'cov' WHEN 2 THEN 'edges_seen' END AS payload_signal, CASE k % 5 WHEN 0 THEN CAST(k AS DOUBLE) WHEN 2 THEN CAST(user_id AS DOUBLE) END AS payload_value FROM b_events""",
    ),
)
def coverage_counters(spark, d):
    tool = _pick(5, F.lit("echidna"), F.lit("medusa"), F.lit("foundry"), F.lit("recon-fuzzer"), F.lit("other"))
    line = _cat("cov: ", _s("event_id"), ", branches hit: ", _s("event_id"), ", Unique instructions: ", _s("event_id"))

    def entry(name, value):
        return F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))

    payload = F.array(entry("coverage", F.lit(5)), entry("worker_cov", F.col("k")), entry("m_edges_seen", F.col("user_id")))
    rows = _ev(spark, d).withColumn("t", S.coverage_from_text(line, tool)).withColumn("p", S.coverage_from_payload(payload, tool))
    return rows.select(
        "event_id", F.col("t.signal").alias("text_signal"), F.col("t.value").alias("text_value"),
        F.col("p.signal").alias("payload_signal"), F.col("p.value").alias("payload_value"),
    )


@query("P12", with_views(_B, "SELECT event_id, event || ' done' AS plain FROM b_events"))
def colour_stripping(spark, d):
    return _ev(spark, d).select("event_id", S.strip_colour(_cat("\x1b[1;31m", F.col("event"), "\x1b[0m done\x1b[m")).alias("plain"))


@query("P13", with_views(_B, "SELECT event_id, CASE WHEN k % 5 <> 4 THEN event END AS name FROM b_events"))
def bang_names(spark, d):
    e = F.col("event")
    line = _pick(5, _cat("x!!! ", e), _cat("!!!", e, " » y!!!"), _cat('"!!! ', e, '" » z'), _cat("(a !!! ", e, ") b"), _cat("!! ", e))
    return _ev(spark, d).select("event_id", S.bang_event(line).alias("name"))


@query("P14", with_views(_B, "SELECT event_id, CASE k % 4 WHEN 0 THEN event WHEN 1 THEN event WHEN 2 THEN 'a:b:' || event END AS name FROM b_events"))
def failure_names(spark, d):
    e = F.col("event")
    raw = _pick(4, _cat("Contract:", e), _cat("  ", e, " "), _cat("a:b:", e), F.lit("  "))
    return _ev(spark, d).select("event_id", S.failure_name(raw).alias("name"))


@query(
    "P16",
    "SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '\\.git$', '') AS repo FROM pages",
)
def repo_urls(spark, d):
    pages = table(spark, d, "pages")
    tail = F.when(F.col("page_id") % 3 == 0, ".git/").when(F.col("page_id") % 3 == 1, "//").otherwise(" ")
    bare = F.regexp_replace(F.regexp_replace(F.trim("url"), "/+$", ""), r"(?i)\.git$", "")
    same = S.repo_url(F.col("url"))
    return pages.select("page_id", F.when(S.repo_url(F.concat(F.lit("  "), F.upper(bare), tail)) == S.repo_url(bare), same).alias("repo"))


@query(
    "P17 P19",
    with_views(_B, "SELECT event_id, CASE k % 4 WHEN 0 THEN 'arm' || k WHEN 1 THEN 'arm' || k WHEN 2 THEN 'solo_' || k ELSE 'arm_x' END AS approach, CASE k % 4 WHEN 0 THEN 'suite__' || event WHEN 1 THEN event END AS suite_test FROM b_events"),
)
def coverage_dirs(spark, d):
    e = F.col("event")
    name = _pick(4, _cat("arm", _s("k"), "__suite__", e), _cat("__arm", _s("k"), "____", e), _cat("solo_", _s("k")), F.lit(" arm +x "))
    rows = _ev(spark, d).withColumn("a", S.coverage_approach(name))
    return rows.select("event_id", S.safe_component("a.approach").alias("approach"), S.safe_component("a.suite_test").alias("suite_test"))


@query(
    "P18",
    with_views(
        _B,
        """SELECT event_id, CASE k % 4 WHEN 3 THEN 'unknown' ELSE 'i-' || lower(to_hex(user_id)) END AS instance_id, event_type || '-v1' AS tool_label,
           CASE WHEN k % 4 IN (0, 1) THEN 'tgt_' || k END AS target_label, CASE k % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'unknown' END AS seed_label FROM b_events""",
    ),
)
def tagged_instances(spark, d):
    base = _cat("i-", F.lower(F.hex("user_id")), "-", F.col("event_type"), "-v1")
    label = _pick(
        4, _cat(base, "__target-tgt ", _s("k"), "__seed-", _s("user_id")), _cat(base, "__target-tgt_", _s("k")), _cat(base, "__seed-.."),
        _cat(F.col("event_type"), "-v1"),
    )
    return _ev(spark, d).select("event_id", S.coverage_instance(label).alias("p")).select("event_id", "p.*")


@query(
    "P22",
    with_views(_B, "SELECT event_id, CASE k % 4 WHEN 0 THEN event || '(uint256,address,int256[])' WHEN 1 THEN event || '(bytes1,(uint256,bool)[])' WHEN 2 THEN event || '()' END AS signature FROM b_events"),
)
def canonical_signatures(spark, d):
    e = F.col("event")
    raw = _pick(4, _cat(" ", e, "(uint , address payable, int[])"), _cat(e, "(byte,( uint,bool )[]) "), _cat(e, "()"), _cat(e, "(uint"))
    return _ev(spark, d).select("event_id", S.canonical_signature(raw).alias("signature"))


@query(
    "P23",
    with_views(_B, "SELECT event_id, CASE WHEN k % 3 < 2 THEN '0x' || lpad(lower(to_hex(event_id)), 8, '0') END AS selector, CASE WHEN k % 3 = 0 THEN '0x' || lpad(lower(to_hex(event_id)), 8, '0') END AS exact FROM b_events"),
)
def calldata_selectors(spark, d):
    head = F.lpad(F.hex("event_id"), 8, "0")
    raw = _pick(3, _cat("0x", head), _cat(" 0x", head, "00000000aAbB "), _cat("0x", F.substring(head, 1, 7)))
    return _ev(spark, d).select("event_id", S.selector_from_calldata(raw).alias("selector"), S.canonical_selector(raw).alias("exact"))


@query(
    "P28",
    with_views(_B, "SELECT event_id, CASE k % 3 WHEN 0 THEN 'master · ' || event WHEN 1 THEN 'custom-arm · ' || event ELSE event_type END AS label FROM b_events"),
)
def short_labels(spark, d):
    raw = _pick(3, _cat("foundry-master__target-", F.col("event")), _cat("custom-arm__target-", F.col("event")), F.col("event_type"))
    return _ev(spark, d).select("event_id", S.short_label(raw).alias("label"))


@query(
    "P35",
    with_views(
        _B,
        """SELECT event_id, CASE k % 5 WHEN 0 THEN 'cov' WHEN 1 THEN 'branches hit' WHEN 2 THEN 'cumulative_edges_seen' WHEN 3 THEN 'Unique instructions' ELSE 'native coverage field' END AS signal,
           CASE k % 5 WHEN 0 THEN 'coverage points' WHEN 1 THEN 'branches' WHEN 2 THEN 'instrumented edges' WHEN 3 THEN 'instructions' ELSE 'tool-defined units' END AS unit, k % 5 < 3 AS is_series FROM b_events""",
    ),
)
def coverage_signals(spark, d):
    tool = _pick(5, F.lit("Echidna-2"), F.lit("medusa"), F.lit(" foundry-x"), F.lit("recon-fuzzer"), F.lit("x-medusa"))
    return _ev(spark, d).select("event_id", S.coverage_signal(tool).alias("s")).select("event_id", "s.*")


@query(
    "P36",
    """SELECT doc_id, regexp_full_match(r, '[A-Za-z0-9][A-Za-z0-9._-]{0,79}') AS run_ok, regexp_full_match(u, '[0-9a-f]{32}') AS uuid_ok,
         regexp_full_match(substr(h, 1, 40 + (doc_id % 2)), '[0-9a-f]{40}') AS commit_ok, regexp_full_match(h, '[0-9a-f]{64}') AS sha_ok, doc_id % 100 BETWEEN 1 AND 72 AS hours_ok
       FROM (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 5 = 0 THEN '-' ELSE '' END || substr(sha256(text), 1, 12) || '.r' AS r,
               CASE WHEN doc_id % 3 = 0 THEN upper(md5(text)) ELSE md5(text) END AS u FROM documents)""",
)
def identity_checks(spark, d):
    i = F.col("doc_id")
    h, m = F.sha2("text", 256), F.md5("text")
    rows = table(spark, d, "documents").select(
        "doc_id", h.alias("h"), F.concat(F.when(i % 5 == 0, "-").otherwise(""), F.substring(h, 1, 12), F.lit(".r")).alias("r"),
        F.when(i % 3 == 0, F.upper(m)).otherwise(m).alias("u"),
    )
    return rows.select(
        "doc_id", F.col("r").rlike(fixed.RUN_ID).alias("run_ok"), F.col("u").rlike(fixed.UUID).alias("uuid_ok"),
        F.substring(F.col("h"), F.lit(1), F.lit(40) + (i % 2).cast("int")).rlike(fixed.COMMIT).alias("commit_ok"),
        F.col("h").rlike(fixed.SHA256).alias("sha_ok"), (i % 100).between(1, 72).alias("hours_ok"),
    )


@query(
    "P37",
    """SELECT md5('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS benchmark_uuid, count(*) AS runs
       FROM orders GROUP BY ALL""",
)
def definition_fingerprints(spark, d):
    rows = table(spark, d, "orders").withColumn("benchmark_uuid", S.fingerprint("o_orderstatus", "o_orderpriority"))
    return rows.groupBy("benchmark_uuid").agg(F.count(F.lit(1)).alias("runs"))
