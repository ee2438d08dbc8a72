"""Queries on saved calls: documents play corpora, their words play calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import payloads
from ..operators import selectors as O
from ..session import fresh_folder
from ..sources.elements import array_elements, read_pieces
from .registry import query
from .views import table, with_views

_ENGINES = {"en": "echidna", "de": "medusa", "fr": "recon-fuzzer"}


def _docs(spark, d):
    engine = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in _ENGINES.items()], F.lit("foundry"))
    return table(spark, d, "documents").select(
        F.lit("r1").alias("run_id"), F.concat_ws("-", F.lit("i"), "source", "lang").alias("instance_label"), engine.alias("engine"), engine.alias("tool"),
        F.col("lang").alias("tool_label"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length("text").cast("bigint").alias("bytes"),
        F.when(F.col("doc_id") % 17 != 0, F.sha2("text", 256)).alias("digest"), "text",
    )


def _calls(spark, d):
    """Every word of every first copy: some calls have a selector, some a name, some both."""
    docs = _docs(spark, d)
    first = O.dedupe(docs).select(*O.INSTANCE, "path")
    word = docs.join(first, [*O.INSTANCE, "path"], "left_semi").select(*O.INSTANCE, F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''")
    n = F.length("w")
    selector = F.concat(F.lit("0x"), F.substring(F.md5("w"), 1, 8))
    return word.select(
        *O.INSTANCE,
        F.when(n % 3 != 0, selector).alias("selector"),
        F.when(n % 4 == 1, F.concat("w", F.lit("()"))).alias("signature"),
        F.when(n % 2 == 1, F.col("w")).alias("name"),
        F.concat(F.lit("f"), (n % 2).cast("string")).alias("source_format"),
    )


def _counts(spark, d):
    return O.counted(_calls(spark, d))


_CALLS = """dc AS (SELECT 'r1' AS run_id, 'i-' || source || '-' || lang AS instance_label, CASE lang WHEN 'en' THEN 'echidna' WHEN 'de' THEN 'medusa' WHEN 'fr' THEN 'recon-fuzzer' ELSE 'foundry' END AS engine, lang AS tool_label,
    doc_id, text, CASE WHEN doc_id % 17 <> 0 THEN sha256(text) END AS digest FROM documents),
  fst AS (SELECT instance_label, digest, min(doc_id) AS doc_id, count(*) AS copies FROM dc WHERE digest IS NOT NULL GROUP BY ALL),
  wd AS (SELECT run_id, instance_label, engine, engine AS tool, tool_label, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM dc WHERE doc_id IN (SELECT doc_id FROM fst)),
  ca AS (SELECT run_id, instance_label, engine, tool, tool_label, CASE WHEN length(w) % 3 <> 0 THEN '0x' || substr(md5(w), 1, 8) END AS selector, CASE WHEN length(w) % 4 = 1 THEN w || '()' END AS signature,
    CASE WHEN length(w) % 2 = 1 THEN w END AS name, 'f' || (length(w) % 2) AS source_format FROM wd WHERE w <> ''),
  ct AS (SELECT *, count(*) AS n FROM ca GROUP BY ALL)"""
_ENRICH = """full_md AS (SELECT DISTINCT selector, signature, name FROM ct WHERE selector IS NOT NULL AND signature IS NOT NULL AND name IS NOT NULL),
  bs AS (SELECT selector, min(name) AS nm, min(signature) AS sg FROM full_md GROUP BY selector HAVING count(*) = 1),
  bn AS (SELECT name, min(selector) AS sl, min(signature) AS sg FROM full_md GROUP BY name HAVING count(*) = 1),
  e1 AS (SELECT run_id, instance_label, engine, tool, tool_label, ct.selector, source_format, n, CASE WHEN bs.selector IS NOT NULL AND (signature IS NULL OR name IS NULL) THEN nm ELSE name END AS name,
    CASE WHEN bs.selector IS NOT NULL AND (signature IS NULL OR name IS NULL) THEN sg ELSE signature END AS signature FROM ct LEFT JOIN bs ON ct.selector = bs.selector),
  en AS (SELECT run_id, instance_label, engine, tool, tool_label, CASE WHEN e1.selector IS NULL AND bn.name IS NOT NULL THEN sl ELSE e1.selector END AS selector,
    CASE WHEN e1.selector IS NULL AND bn.name IS NOT NULL THEN sg ELSE signature END AS signature, e1.name, source_format, n FROM e1 LEFT JOIN bn ON e1.name = bn.name)"""


@query(
    "A27",
    with_views("", "SELECT instance_label, count(*) AS sequences, CAST(sum(copies - 1) AS BIGINT) AS duplicates FROM fst GROUP BY instance_label", _CALLS),
)
def sequence_dedupe(spark, d):
    return O.dedupe(_docs(spark, d)).groupBy("instance_label").agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.col("copies") - 1).alias("duplicates"))


@query(
    "J11",
    with_views("", "SELECT tool, selector, signature, name, CAST(sum(n) AS BIGINT) AS n FROM en GROUP BY ALL", _CALLS + "," + _ENRICH),
)
def enriched_calls(spark, d):
    return O.enrich(_counts(spark, d)).groupBy("tool", "selector", "signature", "name").agg(F.sum("n").alias("n"))


def _dist_sql(by: str) -> str:
    return f"""SELECT {by}, key, max(selector) AS selector, CAST(sum(n) AS BIGINT) AS calls, round(sum(n) / max(total), 12) AS share,
      coalesce(string_agg(DISTINCT signature, ';' ORDER BY signature), '') AS signatures, coalesce(string_agg(DISTINCT name, ';' ORDER BY name), '') AS names, string_agg(DISTINCT source_format, ';' ORDER BY source_format) AS sources
      FROM (SELECT *, coalesce(selector, 'name:' || name, 'unknown') AS key, sum(n) OVER (PARTITION BY {by}) AS total FROM ct) GROUP BY {by}, key"""


@query("A29", with_views("", _dist_sql("instance_label"), _CALLS))
def instance_distribution(spark, d):
    return O.distribution(_counts(spark, d), ["instance_label"])


@query("A29 V4", with_views("", _dist_sql("tool"), _CALLS))
def tool_distribution(spark, d):
    return O.distribution(_counts(spark, d), ["tool"])


@query(
    "T1 V4",
    with_views("", f"SELECT tool, key, calls, share, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY calls DESC, key) AS r FROM ({_dist_sql('tool')})) WHERE r <= 10", _CALLS),
)
def top_calls(spark, d):
    dist = O.distribution(_counts(spark, d), ["tool"])
    w = Window.partitionBy("tool").orderBy(F.desc("calls"), F.asc("key"))
    return dist.select("tool", "key", "calls", "share", F.row_number().over(w).alias("rank")).where(F.col("rank") <= 10)


def _instances(spark, d):
    """Counters per instance, from the documents; nations play instances that saved nothing."""
    docs = _docs(spark, d)
    calls = docs.where(F.col("digest").isNotNull()).select(*O.INSTANCE, (F.col("bytes") % 2 == 0).alias("ignored"), (F.col("bytes") % 10 == 1).alias("mismatch"))
    engine = F.when(F.col("n_regionkey") == 0, "echidna").otherwise("foundry")
    empty = table(spark, d, "nation").select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("i-"), "n_name").alias("instance_label"), engine.alias("engine"), engine.alias("tool"), F.lit("none").alias("tool_label")
    )
    inventory = docs.select(*O.INSTANCE).unionByName(empty.select(*O.INSTANCE)).distinct()
    return O.instance_summary(docs, calls, inventory)


_STATUS = """it AS (SELECT instance_label, engine, tool_label, count(*) FILTER (c) AS artifact_files, count(*) FILTER (c AND digest IS NULL) AS malformed, count(DISTINCT digest) FILTER (c) AS sequences,
    count(*) FILTER (c AND digest IS NOT NULL AND strlen(text) % 2 = 1) AS calls FROM (SELECT instance_label, engine, tool_label, text, digest, true AS c FROM dc
      UNION ALL SELECT 'i-' || n_name, CASE WHEN n_regionkey = 0 THEN 'echidna' ELSE 'foundry' END, 'none', NULL, NULL, false FROM nation) GROUP BY ALL),
  stt AS (SELECT *, CASE WHEN artifact_files = 0 THEN CASE WHEN engine = 'foundry' THEN 'unavailable' ELSE 'observed_zero' END
    WHEN calls > 0 OR sequences > 0 THEN CASE WHEN malformed > 0 THEN 'partial' WHEN calls > 0 THEN 'available' ELSE 'observed_zero' END WHEN malformed > 0 THEN 'malformed' ELSE 'unavailable' END AS status FROM it)"""


@query("A30 A27", with_views("", "SELECT instance_label, artifact_files, malformed, sequences, calls, status FROM stt", _CALLS + "," + _STATUS))
def instance_statuses(spark, d):
    return _instances(spark, d).select("instance_label", "artifact_files", "malformed", "sequences", "calls", "status")


@query(
    "A30 V4",
    with_views(
        "",
        """SELECT engine AS tool, CASE WHEN count(DISTINCT status) = 1 AND min(status) <> 'partial' THEN min(status) ELSE 'partial' END AS status, count(*) AS instances, count(*) FILTER (status IN ('available', 'partial')) AS available,
           count(*) FILTER (status = 'observed_zero') AS observed_zero, count(*) FILTER (status = 'unavailable') AS unavailable, count(*) FILTER (status = 'malformed') AS malformed FROM stt GROUP BY engine""",
        _CALLS + "," + _STATUS,
    ),
)
def tool_statuses(spark, d):
    return O.tool_status(_instances(spark, d))


_PEER = """us AS (SELECT DISTINCT engine, instance_label FROM dc), nd AS (SELECT engine, count(*) AS needed FROM us GROUP BY engine),
  sn AS (SELECT engine, instance_label, selector, min(name) AS nm FROM ct WHERE selector IS NOT NULL GROUP BY ALL HAVING count(DISTINCT name) = 1),
  pe AS (SELECT selector, engine FROM (SELECT selector, engine, count(*) AS have FROM sn GROUP BY ALL) JOIN nd USING (engine) WHERE have = needed),
  ex AS (SELECT selector, string_agg(engine, ',' ORDER BY engine) AS engines, count(DISTINCT CASE engine WHEN 'echidna' THEN 'typed' WHEN 'recon-fuzzer' THEN 'typed' ELSE engine END) AS families FROM pe GROUP BY selector
    HAVING count(DISTINCT CASE engine WHEN 'echidna' THEN 'typed' WHEN 'recon-fuzzer' THEN 'typed' ELSE engine END) >= 2)"""


def _available(spark, d):
    """Instances per language; sources are merged so that shared words exist everywhere."""
    return _docs(spark, d).select(*O.INSTANCE).distinct().withColumn("status", F.lit("available"))


@query("J13", with_views("", "SELECT selector, engines, families FROM ex", _CALLS.replace("'i-' || source || '-' || lang", "'i-' || (doc_id % 2) || '-' || lang") + "," + _PEER))
def peer_expected(spark, d):
    counts, instances = _two_machines(spark, d)
    return O.peer_expected(counts, instances).select("selector", "engines", "families")


def _two_machines(spark, d):
    """The same calls with two machines per language."""
    docs = _docs(spark, d).withColumn("instance_label", F.concat_ws("-", F.lit("i"), (F.col("path").cast("bigint") % 2).cast("string"), "tool_label"))
    first = O.dedupe(docs).select(*O.INSTANCE, "path")
    word = docs.join(first, [*O.INSTANCE, "path"], "left_semi").select(*O.INSTANCE, F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''")
    n = F.length("w")
    calls = word.select(
        *O.INSTANCE,
        F.when(n % 3 != 0, F.concat(F.lit("0x"), F.substring(F.md5("w"), 1, 8))).alias("selector"),
        F.when(n % 4 == 1, F.concat("w", F.lit("()"))).alias("signature"), F.when(n % 2 == 1, F.col("w")).alias("name"),
        F.concat(F.lit("f"), (n % 2).cast("string")).alias("source_format"),
    )
    return O.counted(calls), docs.select(*O.INSTANCE).distinct().withColumn("status", F.lit("available"))


@query(
    "J12 A31",
    with_views("", "SELECT instance_label, selector FROM (SELECT DISTINCT instance_label FROM dc) CROSS JOIN (SELECT selector FROM ct WHERE selector IS NOT NULL GROUP BY selector HAVING count(DISTINCT engine) >= 2) EXCEPT SELECT instance_label, selector FROM ct", _CALLS),
)
def missing_expected(spark, d):
    counts = _counts(spark, d)
    shared = counts.where(F.col("selector").isNotNull()).select("selector", "engine").distinct().groupBy("selector").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return O.missing_expected(shared, counts, _available(spark, d))


@query(
    "A31",
    with_views(
        "",
        """SELECT instance_label, 'malformed_artifact' AS kind, malformed AS amount, 'warning' AS severity FROM stt WHERE malformed > 0
           UNION ALL SELECT instance_label, 'observed_zero', 0, 'warning' FROM stt WHERE status = 'observed_zero'""",
        _CALLS + "," + _STATUS,
    ),
)
def selector_health(spark, d):
    inst = _instances(spark, d)
    return O.health(inst, inst.select("instance_label", F.lit("x").alias("selector")).where("false"))


def _corpus(spark, d):
    """A corpus file per conversation turn, in the four engines' formats by conversation number."""
    conv = table(spark, d, "conversations").withColumn("h", F.md5("text"))
    name = F.concat(F.lit("f_"), F.substring("h", 1, 2))
    tagged = F.concat(F.lit('{"call": {"tag": "SolCall", "contents": ["'), name, F.lit('", [{"tag": "AbiUInt", "contents": [256, "7"]}, {"tag": "AbiAddress", "contents": "0x1"}]]}}'))
    mapped = F.concat(F.lit('{"call": {"SolCall": {"name": "'), name, F.lit('", "args": [{"Uint": ["0x07", 256]}, {"Address": "0x1"}]}}}'))
    data = F.concat(F.lit("0x"), F.substring("h", 1, 8), F.lit("00ff"))
    medusa = F.concat(F.lit('{"call": {"data": "'), data, F.lit('", "dataAbiValues": {"methodSignature": "'), name, F.lit('(uint)"}}}'))
    foundry = F.concat(F.lit('{"calldata": "'), data, F.lit('"}'))
    m = F.col("conv_id") % 4
    item = F.when(m == 0, tagged).when(m == 1, mapped).when(m == 2, medusa).otherwise(foundry)
    engines = F.array(*[F.lit(e) for e in ("echidna", "recon-fuzzer", "medusa", "foundry")])
    engine = F.get(engines, m.cast("int"))
    return conv.select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("i-0"), (F.col("conv_id") % 8).cast("string"), F.lit("-"), engine).alias("instance_label"),
        engine.alias("engine"), engine.alias("tool"), engine.alias("tool_label"),
        F.concat_ws("/", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 9, "0")).alias("path"),
        F.octet_length(item).cast("bigint").alias("bytes"), F.concat(F.lit("["), item, F.lit("]")).alias("content"),
    )


@query("P24 P25 P26 P27 A28 S6")
def corpus_calls(spark, d):
    files = O.sequences(_corpus(spark, d))
    return O.counted(O.resolve(O.extract_calls(files)))


@query("A27 A30 P27")
def corpus_instances(spark, d):
    return O.analyze(_corpus(spark, d))["instances"].drop("warnings")


@query("P24")
def signature_selectors(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("w <> ''").distinct()
    return words.select(F.concat("w", F.lit("(uint256)")).alias("signature")).withColumn("selector", payloads.signature_selector("signature"))


@query("D3")
def expected_selector_checks(spark, d):
    """Reviewed entries made from part names; some disagree with their signature."""
    p = table(spark, d, "part")
    word = F.regexp_replace("p_name", "[^a-z]", "_")
    k = F.col("p_partkey")
    entries = p.select(
        F.when(k % 5 == 0, F.concat(F.lit("0x"), F.substring(F.md5(word), 1, 8))).when(k % 7 == 0, "zz").alias("selector"),
        F.when(k % 3 != 0, F.concat(word, F.lit("(uint)"))).alias("signature"), F.when(k % 4 == 0, word).when(k % 11 == 0, "1bad").alias("function_name"),
    )
    return O.expected_catalog(entries)[1].groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S6 P26",
    """SELECT 'f' || (conv_id % 8) AS file, CAST(row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS BIGINT) AS part, role, md5(text) AS text_md5,
         count(*) OVER (PARTITION BY conv_id % 8) AS elements FROM conversations""",
)
def corpus_elements(spark, d):
    """Conversations written as eight large JSON arrays, read in splits and cut into elements."""
    root = fresh_folder(spark, "arrays")
    conv = table(spark, d, "conversations").withColumn("file", F.concat(F.lit("f"), (F.col("conv_id") % 8).cast("string")))
    item = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    order = Window.partitionBy("file").orderBy("conv_id", "turn")
    last = F.lead("conv_id").over(order).isNull()
    line = F.concat(F.when(F.row_number().over(order) == 1, "[").otherwise(""), item, F.when(last, "]").otherwise(","))
    # the window deals files out and sorts them, so that a file has one writer
    conv.select("file", line.alias("line")).write.partitionBy("file").text(root)
    items, files = array_elements(read_pieces(spark, root))
    value = lambda name: F.try_variant_get(F.try_parse_json("text"), f"$.{name}", "string")
    rows = items.join(files.where("well_formed"), "path")
    return rows.select(F.regexp_extract("path", "file=(f[0-9])", 1).alias("file"), "part", value("role").alias("role"), F.md5(value("text")).alias("text_md5"), "elements")
