"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import let
from ..session import fresh_folder, pin
from . import ann, bpe, chat, common, decontam, langid, periods, pii, sharding, simhash, toxicity, urlfilter, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(common.bounded(pin(spark)), sf_dir)
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def public_vocabulary() -> tuple[str, str]:
    """The rank file and the pattern of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query()
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    spans = docs.select("doc_id", pii.found(pii.fit(docs), F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    written = lambda every: F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    is_base = lambda kind: lambda s: s["base"] & (s["kind"] == kind)
    counts = [F.size(F.filter("found", is_base(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return spans.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.id_remainder(F.col("doc_id"), 3) == 1
    labels = common.table(spark, sf_dir, "labels").where(common.id_remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(labels, docs)
    found = docs.select("doc_id", held.alias("held_out"), toxicity.tagged(model, F.col("text")).alias("t"))
    spans = F.array_join(F.transform("t.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.7).cast("int").alias("predicted"), spans.alias("toxic_spans"))


@query()
def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.id_remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), langid.predicted(model, F.col("text")).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@query(WARC_SQL)
def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = common.table(spark, sf_dir, "pages"), fresh_folder(spark, "warc")
    return warc.read(pages, folder, warc.write(pages, folder))


@query()
def op7_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(common.table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts: additions and removals of a host or its parent domain.

    A stand-in for list dumps: dates, categories and the removals follow from a digest of the rule.
    """
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
    rules = hosts.select("host", F.lit("h").alias("via")).union(hosts.select(F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1), F.lit("d"))).where("host <> ''").distinct()
    digest = F.md5(F.concat("host", "via", F.col("n").cast("string")))
    number = lambda at: F.conv(F.substring(digest, at, 4), 16, 10).cast("int")
    changes = rules.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3))))
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("allow")), number(9) % 3 + 1)
    return changes.select(F.col("host").alias("rule"), F.date_add(F.lit("2020-01-01").cast("date"), number(1) % 1500).alias("at"), (number(5) % 2 == 0).alias("listed"), category.alias("category"))


def with_fetch_days(pages: DataFrame) -> DataFrame:
    """`pages` has no fetch time: a day from the id, over 1500 days."""
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), (F.pmod(F.col("page_id") * 7919, F.lit(1500))).cast("int")).alias("fetched_on"))


URL_LIST_SQL = """
WITH p AS (
  SELECT page_id, url, DATE '2020-01-01' + CAST(((page_id * 7919) % 1500 + 1500) % 1500 AS INTEGER) AS fetched_on,
         nullif(rtrim(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
         regexp_extract(url, '^(?i:https?)://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT DISTINCT host, 'h' AS via FROM p WHERE host IS NOT NULL
  UNION SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1), 'd' FROM p WHERE regexp_extract(host, '([^.]+[.][^.]+)$', 1) <> ''),
c AS (SELECT host AS rule, md5(concat(host, via, CAST(n AS VARCHAR))) AS d FROM r, (SELECT unnest([0, 1, 2, 3]) AS n)),
e AS (
  SELECT rule, DATE '2020-01-01' + CAST(CAST('0x' || substr(d, 1, 4) AS INTEGER) % 1500 AS INTEGER) AS valid_from,
         CAST('0x' || substr(d, 5, 4) AS INTEGER) % 2 = 0 AS listed,
         ['adult', 'malware', 'allow'][CAST('0x' || substr(d, 9, 4) AS INTEGER) % 3 + 1] AS category FROM c),
g AS (
  SELECT rule, valid_from, bool_or(listed) AS listed,
         coalesce(min(category) FILTER (listed), min(category)) AS category FROM e GROUP BY ALL),
i AS (SELECT * FROM (SELECT *, lead(valid_from) OVER (PARTITION BY rule ORDER BY valid_from) AS valid_until FROM g) WHERE listed),
k AS (
  SELECT *, string_split(host, '.') AS parts, string_split(path, '/') AS steps FROM p),
a AS (
  SELECT page_id, fetched_on, array_to_string(parts[j:], '.') AS rule, len(parts) - j + 1 AS precision_
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS j FROM k WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, fetched_on, concat(host, array_to_string(steps[1:j], '/'), '/'), len(parts) + j
  FROM (SELECT *, unnest(generate_series(1, len(steps) - 1)) AS j FROM k WHERE host IS NOT NULL)),
m AS (
  SELECT a.page_id, i.rule, i.category, i.valid_from, count(*) OVER (PARTITION BY a.page_id) AS n_active,
         row_number() OVER (PARTITION BY a.page_id ORDER BY a.precision_ DESC, i.rule) AS nth
  FROM a JOIN i ON a.rule = i.rule AND a.fetched_on >= i.valid_from AND (i.valid_until IS NULL OR a.fetched_on < i.valid_until))
SELECT p.page_id, p.host, p.fetched_on,
       CASE WHEN m.rule IS NULL THEN 'none' WHEN m.category = 'allow' THEN 'allow' ELSE 'block' END AS verdict,
       m.rule, m.category, m.valid_from, coalesce(m.n_active, 0) AS n_active
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.nth = 1
"""


@query(URL_LIST_SQL)
def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return urlfilter.judged(with_fetch_days(pages), urlfilter.intervals(dated_list(pages)))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    both = common.table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), path, pattern).alias("b"))
    return both.select("doc_id", F.size("b.ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("b.ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("b.decoded"), 256).alias("decoded_sha256"))


@query()
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of the documents, by crc32 of the id, the words from some place on repeat the first of them.

    A null id counts as the empty text, a null text as no words.
    """
    sign = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(sign / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")

    def tail(w):
        n = F.greatest(F.size(w), F.lit(1))
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeated = F.transform(F.sequence(a, (n - 1).cast("long")), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), repeated), " ")

    text = F.when(sign % 10 == 0, let(words, tail)).otherwise(F.col("text"))
    return docs.select("doc_id", F.explode(F.array(text)).alias("text"))  # Spark takes no lambda inside a Python function's argument


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words in all documents; every run and the collapsed text enter a digest."""
    docs = with_periodic_tails(common.table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", periods.found(F.col("text")).alias("f"))
    lines = F.array_join(F.transform("f.runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    longest = F.array_min(F.transform("f.runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select("doc_id", F.size("f.runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("f.collapsed"), 256).alias("collapsed_sha256"))
    length, period = -F.col("top.less"), F.col("top.period")
    return rows.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the 32 components with most variance, fitted on all of them."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return whitening.transform(vectors, whitening.fit(vectors))


#: A conversation whose texts hold the template's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, 12 + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|break|>')) + 1
            + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11 AS size,
         row_number() OVER w AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, r DESC NULLS LAST, x DESC NULLS LAST) AS back
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)),
e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query(CHAT_SQL)
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's marks, formatted and read back from the examples."""
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    return chat.read_back(chat.examples(turns.union(marks)))
