"""The queries of this subpackage, with their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, licenses, manifest, minhash, mixing, packing, quality, repair, scoring, sharding, sql, substrings, warc
from .common import new_path, read, text_or_empty

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: A user and an assistant that say what could be taken for control strings.
PROBE = [(-7, t, role, r"\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]


@query
def op1_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(turns))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_left").cast("long").alias("n_left"))


@query
def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(read(spark, sf_dir, "documents"))
    return packing.place(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


@query
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.write_shards(sharding.shard(read(spark, sf_dir, "documents")), new_path(spark, "shards"))
    return d.select("doc_id", "size", F.crc32(text_or_empty("text")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.write(read(spark, sf_dir, "pages")).records()
    field = lambda name, prefix: F.substring_index(F.split(warc.header_field(F.col("header"), name), prefix)[1], ">", 1)
    return records.select(
        field("WARC-Record-ID", "urn:page:").try_cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32_sha1(F.col("payload")).alias("payload_digest"), warc.header_field(F.col("header"), "WARC-Type").alias("record_type"),
        field("WARC-Refers-To", "urn:page:").try_cast("long").alias("refers_to"),
    )


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substrings.cut(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprints.with_next(read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(turns, repair.damage(turns))


@query
def op12_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"), claimed=manifest.without_newlines())


ORACLES["op11_repair_conversations"] = sql.repair_oracle()
ORACLES["op13_merkle_manifest"] = sql.manifest_oracle()

ORACLES["op1_format_chats"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<turn', ''))) // 5
    + (length(text) - length(replace(text, '</turn', ''))) // 6 + length(regexp_replace(role, '([\\<>])', '\\\1', 'g')) + 16 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op7_warc_archive"] = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM w
"""

ORACLES["op2_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS most FROM s),
f AS (SELECT *, most::DOUBLE / w::DOUBLE AS fill FROM w),
o AS (
  SELECT *, row_number() OVER (ORDER BY fill, source NULLS LAST) AS r,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS share
  FROM f),
c AS (SELECT min(r) AS r0 FROM o WHERE share <= fill),
t AS (SELECT o.*, CASE WHEN o.r < c.r0 THEN o.most::DOUBLE ELSE (SELECT share FROM o, c WHERE o.r = c.r0) * o.w END AS target FROM o, c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target,
  CAST(b.epochs * p.size + greatest(0, least(p.size, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size - p.first)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""

def quality_oracle(max_docs: int = quality.MAX_DOCS) -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
n AS (SELECT r, source, text, l AS line, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, source, text, unnest(lines) AS l FROM d)),
q AS (SELECT source, norm FROM n GROUP BY source, norm HAVING count(DISTINCT text) > {max_docs}),
g AS (SELECT n.r, sum(n.n) AS gone FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source AND n.norm = q.norm GROUP BY n.r),
i AS (SELECT r, unnest(range(1, len(words) - 3)) AS p FROM d),
v AS (SELECT i.r, p, array_to_string(list_slice(words, p, p + 4), ' ') AS win FROM i JOIN d ON i.r = d.r),
u AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS c FROM v) WHERE c > 1),
x AS (SELECT r, sum(least(5, coalesce(nxt - p, 5))) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM u) GROUP BY r),
e AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.gone, 0) AS BIGINT) AS gone
  FROM d LEFT JOIN x ON d.r = x.r LEFT JOIN g ON d.r = g.r),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - gone AS n_left FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (gone > 0 AND (n_left < 10 OR n_left < 0.25 * n_words)) AS kept, n_left FROM k
"""


ORACLES["op4_quality_rules"] = quality_oracle()


def _license_oracle() -> str:
    words_in = lambda ws: "[" + ", ".join(map(repr, ws)) + "]::VARCHAR[]"
    rows = []
    for label, text in licenses.TEMPLATES:
        tw = licenses.template_words(text)
        telling = [w for w in tw if w in licenses.TELLING and len(tw) <= licenses.SHORT]
        rows.append(f"('{label}', {words_in(tw)}, {len(licenses.template_run(text))}, {words_in(telling)})")
    at = " OR ".join("(" + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p.split(), 1)) + ")" for p in licenses.PHRASES)
    base = ", ".join(f"CASE WHEN contains(joined, ' {p} ') THEN '{label}' END" for p, label in licenses.PHRASES.items())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    enough = f">= ceil({licenses.CONTAINMENT} * len(tw) - 1e-9)"
    return rf"""
WITH t(label, tw, run, telling) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low, regexp_extract_all({low}, '{word}') AS words FROM documents),
j AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS joined FROM d),
p AS (SELECT *, list_filter(range(0, len(words)), lambda i: {at}) AS pl, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM j),
l AS (SELECT r, regexp_extract_all(unnest(string_split(low, chr(10))), '{word}') AS bw FROM d),
v AS (SELECT r, label, tw, telling, unnest(list_transform(list_filter(range(0, len(words)), lambda i: list_contains(tw, words[i + 1])), lambda i: list_slice(words, i + 1, i + run))) AS bw
  FROM d, t WHERE contains(low, chr(10)) AND len(list_intersect(list_distinct(words), tw)) {enough}),
b AS (SELECT r, label, tw, telling, list_distinct(bw) AS bw FROM v UNION ALL SELECT r, label, tw, telling, list_distinct(bw) FROM l, t),
m AS (SELECT r, label, len(list_intersect(bw, tw))::DOUBLE / len(tw) AS c FROM b WHERE len(list_intersect(bw, tw)) {enough} AND len(list_intersect(bw, telling)) = len(telling)),
g AS (SELECT r, list(DISTINCT label) AS more, max(c) AS best FROM m GROUP BY r)
SELECT p.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(pl) AS BIGINT) AS n_base, CAST(list_min(pl) AS BIGINT) AS first_word, CAST(list_max(pl) AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(g.more, [])))), ',') AS labels,
  CASE WHEN len(pl) > 0 THEN 1.0::DOUBLE ELSE coalesce(g.best, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN g ON p.r = g.r
"""


ORACLES["op8_license_scan"] = _license_oracle()


ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT r, unnest(range(1, len(words) - 33)) AS p FROM d),
v AS (SELECT i.r, p, hash(list_slice(words, p, p + 34)) AS h, md5(array_to_string(list_slice(words, p, p + 34), ' ')) AS m FROM i JOIN d ON i.r = d.r),
u AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h, m) AS c FROM v) WHERE c > 1),
g AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM u),
a AS (SELECT r, list(p) AS gone FROM g GROUP BY r),
k AS (SELECT d.doc_id, len(words) AS n, coalesce(len(gone), 0) AS n_gone, CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(gone, j)), lambda j: words[j]) END AS kept
  FROM d LEFT JOIN a ON d.r = a.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

ORACLES["op3_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(2, len(w) - 3) END)) AS p FROM d),
s AS (SELECT DISTINCT i.doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM i JOIN d ON i.doc_id = d.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM x JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d JOIN r ON d.doc_id = r.a LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id
"""
