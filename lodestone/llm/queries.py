"""The operators' queries over the given tables, and their SQL where SQL has the words."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, collocations, decontaminate, embeddings, kneser_ney, packing, sharding, simhash, spelling, substrings, token_files, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures, fetched on day ``page_id % 365`` of 2024, against a list history drawn
    from their own hosts: every third domain is listed, delisted 90 days later and listed
    again 200 days after the first time; every fifth host is listed for itself."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda c: F.timestamp_seconds(F.lit(1704067200) + c * 86400)
    captures = pages.withColumn("fetched", day(F.col("page_id") % 365))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.min("page_id").alias("first")).where("host is not null")
    domains = hosts.groupBy(F.substring_index("host", ".", -3).alias("rule")).agg(F.min("first").alias("first")).where("first % 3 = 0")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), F.lit(n).alias("after")) for a, n in (("add", 0), ("remove", 90), ("add", 200)))))
    listed = domains.select("rule", "first", steps.alias("s")).select("rule", F.col("s.action").alias("action"), F.lit("domain list").alias("reason"), day(F.col("first") % 100 + F.col("s.after")).alias("from_time"))
    single = hosts.where("first % 5 = 0").select(F.col("host").alias("rule"), F.lit("add").alias("action"), F.lit("host list").alias("reason"), day(F.col("first") % 300).alias("from_time"))
    return url_filter.filter_urls(captures, listed.unionByName(single), "page_id").withColumnRenamed("capture_id", "page_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At order two: order three, the operator's default, needs more than the limit of disk (README has the figures)."""
    return kneser_ney.held_out_scores(_table(spark, sf_dir, "documents"), order=2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), damage=97)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_toxicity, op4_substrings, op5_sharding, op6_decontamination, op7_url_filter, op8_token_files, op9_embeddings, op10_kneser_ney, op11_collocations, op12_packing, op13_spelling)}
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op7_url_filter"] = r"""
WITH caps AS (
  SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$|\.+$', ''), '\.+$', ''), '') AS host,
         CAST(page_id % 365 AS BIGINT) AS fetched
  FROM pages),
hosts AS (SELECT host, min(page_id) AS first FROM caps WHERE host IS NOT NULL GROUP BY host),
domains AS (
  SELECT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS rule, min(first) AS first
  FROM hosts GROUP BY 1 HAVING min(first) % 3 = 0),
entries AS (
  SELECT rule, 'add' AS action, 'domain list' AS reason, first % 100 AS from_time FROM domains
  UNION ALL SELECT rule, 'remove', 'domain list', first % 100 + 90 FROM domains
  UNION ALL SELECT rule, 'add', 'domain list', first % 100 + 200 FROM domains
  UNION ALL SELECT host, 'add', 'host list', first % 300 FROM hosts WHERE first % 5 = 0),
once AS (
  SELECT rule, from_time, action, reason FROM (
    SELECT *, row_number() OVER (PARTITION BY rule, from_time ORDER BY (action <> 'remove'), reason) AS n FROM entries) WHERE n = 1),
spans AS (
  SELECT rule, action, reason, from_time AS valid_from, lead(from_time) OVER (PARTITION BY rule ORDER BY from_time) AS valid_to FROM once),
best AS (
  SELECT c.page_id, s.rule, s.reason,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.rule) DESC, s.reason, s.rule) AS n
  FROM caps c JOIN spans s ON s.action = 'add' AND (c.host = s.rule OR ends_with(c.host, '.' || s.rule))
   AND c.fetched >= s.valid_from AND (s.valid_to IS NULL OR c.fetched < s.valid_to))
SELECT c.page_id, c.host, b.rule IS NOT NULL AS blocked, b.rule, b.reason
FROM caps c LEFT JOIN best b ON b.page_id = c.page_id AND b.n = 1
"""

ORACLE_SQL["op4_substrings"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS g,
  count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM words),
again AS (SELECT g FROM win WHERE n = 35 GROUP BY g HAVING count(*) > 1),
marked AS (SELECT x.doc_id, x.i, a.g IS NOT NULL AS starts FROM win x LEFT JOIN again a ON a.g = x.g AND x.n = 35),
covered AS (SELECT doc_id, i, max(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT c.doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM covered c JOIN words USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL["op6_decontamination"] = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS bs FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT DISTINCT item_id, array_to_string(bs[i:i + 12], ' ') AS g, least(len(bs), 13) AS n FROM (SELECT *, unnest(range(1, greatest(len(bs) - 12, 1) + 1)) AS i FROM b WHERE len(bs) > 0)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g,
  count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM words),
short AS (SELECT DISTINCT n FROM items WHERE n < 13),
every AS (SELECT doc_id, i, g, n FROM win UNION ALL SELECT doc_id, i, array_to_string(string_split(g, ' ')[1:s.n], ' '), s.n FROM win JOIN short s ON s.n < win.n),
met AS (SELECT e.doc_id, e.i, e.n, t.item_id FROM every e JOIN items t ON t.g = e.g AND t.n = e.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLE_SQL["op9_embeddings"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, x.b FROM reach r JOIN edges x ON r.b = x.a),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM edges GROUP BY a)
SELECT m.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, p.component_id, m.vec_id = p.component_id AS kept
FROM embeddings m JOIN part p ON p.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""

# a checksum's steps are a list: a byte goes in where a number stands, then come eight shifts
ORACLE_SQL["op13_spelling"] = r"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
steps AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda k:
    CASE WHEN ord(k) < 128 THEN [ord(k), -1, -1, -1, -1, -1, -1, -1, -1] ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, ord(k) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)) AS s FROM r),
h AS (SELECT doc_id, run, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(s AS BIGINT[])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS h FROM steps),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
pat AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
lost AS (SELECT DISTINCT p.word, p.n, w.word AS other, w.n AS m FROM pat p JOIN w ON w.word = p.a || p.b),
near AS (SELECT p.word, q.word AS other, q.n AS m FROM pat p JOIN pat q ON p.a || '_' || p.b = q.a || '_' || q.b AND p.word <> q.word
  UNION ALL SELECT word, other, m FROM lost UNION ALL SELECT other, word, n FROM lost),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS b FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN forms f ON f.word = way.here WHERE f.form IS NOT NULL),
last AS (SELECT word, max_by(here, k) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""

ORACLE_SQL["op11_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, ws[i:i + k - 1] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM ws), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, w, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(w) = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE len(w) > 1 AND a >= 30),
subs AS (SELECT lang, w[i:i + k - 1] AS w, max(a) AS longer FROM (SELECT lang, w, a, unnest(range(1, len(w) + 1)) AS i FROM cand), (SELECT unnest([2, 3]) AS k) WHERE i + k - 1 <= len(w) AND k < len(w) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN subs s ON s.lang = c.lang AND s.w = c.w WHERE s.longer IS NULL OR CAST(100 AS HUGEINT) * s.longer < CAST(80 AS HUGEINT) * c.a),
cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM kept),
scored AS (SELECT c.lang, c.w, c.a, c.k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:c.k] JOIN f y ON y.lang = c.lang AND y.w = c.w[c.k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(w, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM best QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang)
"""
