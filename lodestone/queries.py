"""The registered queries: each operator over the given tables, with its SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths, text, vectors
from lodestone.operators import chunks, embed, guard, metrics, search, sync
from lodestone.plans import ingest, migrate, search as plan
from lodestone.sources import collection, corpus, imports, pages, store
from lodestone.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- the given tables as corpus files, stored points, vectors, logs ----


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of one root for each source, some of them in places and of kinds that are not read."""
    i = F.col("doc_id")
    folder = F.when(i % 11 == 0, "node_modules/").when(i % 11 == 1, "src/build/").otherwise(F.concat("lang", F.lit("/")))
    name = F.when(i % 13 == 0, "my-Secret").when(i % 13 == 1, "build").otherwise("doc")
    root = F.concat(F.lit("/corpus/"), "source")
    path = F.concat(root, F.lit("/"), folder, name, i.cast("string"), _pick(i % 8, ".go", ".md", ".PY", ".txt", ".bin", ".env", ".json", ".yaml"))
    return _t(spark, d, "documents").select("doc_id", F.col("source").alias("project_id"), root.alias("root"), path.alias("path"), F.col("text").alias("content"), F.octet_length("text").alias("length"))


FILES = """files AS (SELECT doc_id, source AS project_id, '/corpus/' || source AS root,
  '/corpus/' || source || '/' || CASE doc_id % 11 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/build/' ELSE lang || '/' END
  || CASE doc_id % 13 WHEN 0 THEN 'my-Secret' WHEN 1 THEN 'build' ELSE 'doc' END || doc_id
  || (['.go', '.md', '.PY', '.txt', '.bin', '.env', '.json', '.yaml'])[doc_id % 8 + 1] AS path,
  text AS content, strlen(text) AS length FROM documents)"""
CANDIDATES = (
    FILES
    + """, named AS (SELECT *, substr(path, length(root) + 2) AS source_file, split_part(root, '/', -1) AS source_dir, split_part(path, '/', -1) AS name FROM files),
candidates AS (SELECT * FROM named WHERE NOT list_has_any(string_split(source_file, '/')[1:-2], ["""
    + ", ".join(f"'{x}'" for x in paths.IGNORED_DIRS)
    + """]) AND (regexp_extract(lower(name), '(\\.[^.]*)$', 1) IN ("""
    + ", ".join(f"'{x}'" for x in paths.EXTENSIONS)
    + """) OR lower(name) IN ("""
    + ", ".join(f"'{x}'" for x in paths.BARE_NAMES)
    + """)) AND NOT (lower(name) IN ("""
    + ", ".join(f"'{x}'" for x in paths.SENSITIVE_NAMES)
    + """) OR lower(name) LIKE '.env.%' OR lower(name) LIKE '%.env' OR lower(name) LIKE '%secret%' OR lower(name) LIKE '%credential%' OR lower(name) LIKE '%password%'
  OR regexp_extract(lower(name), '(\\.[^.]*)$', 1) IN ("""
    + ", ".join(f"'{x}'" for x in paths.SENSITIVE_EXTENSIONS)
    + ")))"
)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return corpus.candidate_files(files(spark, d))


CHUNKED = """pieces AS (SELECT project_id, source_file, source_dir, CASE WHEN length(content) <= {size} THEN [content] ELSE
  list_transform([list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'open': '', 's': '', 'hard': false}},
      flatten(list_transform(string_split(content, chr(10)), lambda line: list_concat(
        list_transform(range(0, greatest(CAST(ceil(length(line) / {size}) AS BIGINT) - 1, 0)), lambda i: {{'done': CAST([] AS VARCHAR[]), 'open': '', 's': substr(line, i * {size} + 1, {size}), 'hard': true}}),
        [{{'done': CAST([] AS VARCHAR[]), 'open': '', 's': substr(line, greatest(CAST(ceil(length(line) / {size}) AS BIGINT) - 1, 0) * {size} + 1), 'hard': false}}])))),
    lambda a, p: {{
      'done': CASE WHEN a.open <> '' AND (p.hard OR length(a.open) + length(p.s) + 1 > {size}) THEN
          CASE WHEN p.hard THEN list_concat(a.done, [a.open, p.s]) ELSE list_append(a.done, a.open) END
        ELSE CASE WHEN p.hard THEN list_append(a.done, p.s) ELSE a.done END END,
      'open': CASE WHEN p.hard THEN '' WHEN a.open <> '' AND length(a.open) + length(p.s) + 1 > {size} THEN p.s || chr(10) ELSE a.open || p.s || chr(10) END,
      's': '', 'hard': false}})], lambda r: CASE WHEN r.open <> '' THEN list_append(r.done, r.open) ELSE r.done END)[1] END AS parts
  FROM {source} WHERE length BETWEEN 1 AND 512000),
chunked AS (SELECT project_id, source_file, source_dir, i - 1 AS chunk_index, parts[i] AS chunk FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pieces)),
scanned AS (SELECT project_id, source_dir || '/' || source_file || '#chunk' || chunk_index AS id, source_dir || '/' || source_file || '#chunk' || chunk_index AS doc_id,
  'File: ' || source_file || chr(10) || chr(10) || chunk AS content, source_file, source_dir, chunk_index, substr(sha256(chunk), 1, 16) AS content_hash, 'v2' AS chunk_version FROM chunked)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Documents as stored points, five to a document, some without a file."""
    i = F.col("doc_id")
    name = F.concat("lang", F.lit("/d"), F.floor(i / 5).cast("string"))
    return _t(spark, d, "documents").select(
        F.col("source").alias("project_id"),
        i.cast("string").alias("id"),
        F.concat("source", F.lit("/"), name, F.lit("#"), (i % 5).cast("string")).alias("doc_id"),
        F.col("text").alias("content"),
        F.when(i % 17 == 0, "").otherwise(F.concat(name, F.lit(".md"))).alias("source_file"),
        F.col("source").alias("source_dir"),
        (i % 12).cast("string").alias("chunk_index"),
        text.content_hash(F.col("text")).alias("content_hash"),
        F.create_map(F.lit("lang"), "lang", F.lit("bucket"), F.concat(F.lit("b"), (i % 4).cast("string")), F.lit("content"), F.lit("x")).alias("meta"),
    )


POINTS = """points AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS id, source || '/' || lang || '/d' || (doc_id // 5) || '#' || (doc_id % 5) AS doc_id, text AS content,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE lang || '/d' || (doc_id // 5) || '.md' END AS source_file, source AS source_dir, CAST(doc_id % 12 AS VARCHAR) AS chunk_index,
  substr(sha256(text), 1, 16) AS content_hash, lang, 'b' || (doc_id % 4) AS bucket, doc_id AS n FROM documents)"""


def vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document and every vector as chunks of one project; what has no text is empty, what has no vector is found by words only."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    i, content = F.col("vec_id"), F.coalesce("text", F.lit(""))
    return _t(spark, d, "embeddings").select("vec_id", "embedding").join(docs, "vec_id", "full").select(
        F.lit("p").alias("project_id"), i.cast("string").alias("id"), F.concat(F.lit("d"), F.floor(i / 4).cast("string"), F.lit("#"), (i % 4).cast("string")).alias("doc_id"),
        content.alias("content"), text.content_hash(content).alias("content_hash"), "embedding",
    )


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector asks, with the whole text of a benchmark item."""
    asks = _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("p").alias("project_id"), F.col("embedding").alias("query_vec"))
    words = _t(spark, d, "benchmark").select((F.col("item_id") * 50).alias("query_id"), F.col("text").alias("query"))
    return asks.join(words, "query_id", "left").withColumn("query", F.coalesce("query", F.lit("")))


def word_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item asks with its whole text."""
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("p").alias("project_id"), F.coalesce("text", F.lit("")).alias("query"))


DENSE = """vc AS (SELECT 'p' AS project_id, CAST(coalesce(vec_id, doc_id) AS VARCHAR) AS id, 'd' || (coalesce(vec_id, doc_id) // 4) || '#' || (coalesce(vec_id, doc_id) % 4) AS doc_id, coalesce(text, '') AS content,
  substr(sha256(coalesce(text, '')), 1, 16) AS content_hash, CAST(embedding AS DOUBLE[]) AS e FROM embeddings FULL JOIN documents ON doc_id = vec_id),
vq AS (SELECT vec_id AS query_id, 'p' AS project_id, CAST(embedding AS DOUBLE[]) AS q, coalesce(query, '') AS query FROM embeddings
  LEFT JOIN (SELECT item_id * 50 AS query_id, text AS query FROM benchmark) b ON b.query_id = vec_id WHERE vec_id % 50 = 0),
bq AS (SELECT item_id AS query_id, 'p' AS project_id, coalesce(text, '') AS query FROM benchmark),
scored AS (SELECT query_id, id, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS score FROM vq JOIN vc USING (project_id) WHERE e IS NOT NULL),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored QUALIFY rank <= {k})"""
WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
LEXICAL = (
    """terms AS (SELECT query_id, project_id, list_distinct(ws) AS terms, ws FROM (SELECT query_id, project_id, """
    + WORDS.format("query")
    + """ AS ws FROM vq)),
lw AS (SELECT project_id, id, """
    + WORDS.format("content")
    + """ AS words FROM vc),
matched AS (SELECT t.query_id, l.id, t.terms, l.words FROM terms t JOIN lw l USING (project_id) WHERE len(t.terms) > 0 AND list_has_all(l.words, t.terms)),
hits AS (SELECT query_id, id, len(terms) AS n, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word, terms FROM matched),
kept AS (SELECT query_id, id, n, place, word FROM hits WHERE list_contains(terms, word)),
pairs AS (SELECT a.query_id, a.id, 1 - product(1 - sqrt(0.01 * CASE WHEN b.place - a.place > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp((b.place - a.place) / 1.5 - 2)) END)) AS score
  FROM kept a JOIN kept b ON a.query_id = b.query_id AND a.id = b.id AND a.place < b.place AND a.word <> b.word WHERE a.n > 1 GROUP BY ALL),
singles AS (SELECT query_id, id, 0.1 * list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0 / (j * j))) / 1.64493406685 AS score FROM kept WHERE n = 1 GROUP BY query_id, id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM singles) QUALIFY rank <= 25)"""
)
FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.id, l.id) AS id, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS score,
    d.id IS NOT NULL AS in_dense, l.id IS NOT NULL AS in_lexical FROM dense d FULL JOIN lexical l ON d.query_id = l.query_id AND d.id = l.id) QUALIFY rank <= 25)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as query metrics and log entries."""
    i = F.col("event_id")
    return _t(spark, d, "events").select(
        i.alias("id"), "ts", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("project_id"), F.col("event_type").alias("query"), F.col("value").alias("latency_ms"),
        (i % 4).cast("int").alias("results"), F.round(F.col("value") / 100, 4).alias("top_score"), (i % 2 == 0).alias("reranked"), (i % 3 == 0).alias("no_log"),
    )


LOG = """qlog AS (SELECT event_id AS id, ts, 'u' || (user_id % 7) AS project_id, event_type AS query, value AS latency_ms, CAST(event_id % 4 AS INTEGER) AS results,
  round(value / 100, 4) AS top_score, event_id % 2 = 0 AS reranked, event_id % 3 = 0 AS no_log FROM events)"""


def _r(c: str | Column) -> Column:
    return F.round(c, 6)


# ---- scans, predicates, chunks ----


@query(f"WITH {FILES} SELECT project_id, path, length FROM files WHERE length BETWEEN 1 AND 2000")
def size_bounds(spark, d):
    return files(spark, d).where(paths.in_size(F.col("length"), 2000)).select("project_id", "path", "length")


@query(f"WITH {CANDIDATES} SELECT project_id, source_dir, source_file FROM candidates")
def scan_candidates(spark, d):
    return candidates(spark, d).select("project_id", "source_dir", "source_file")


@query(f"""WITH {FILES} SELECT project_id, path, list_has_any(string_split(substr(path, length(root) + 2), '/')[1:-2], ['node_modules', 'build', 'src']) AND path NOT LIKE '%/src/doc%' AS pruned FROM files""")
def prune_dirs(spark, d):
    return files(spark, d).select("project_id", "path", paths.is_pruned(paths.rel_path(F.col("root"), F.col("path"))).alias("pruned"))


@query(f"WITH {FILES} SELECT DISTINCT root, split_part(root, '/', -1) AS source_dir, min(substr(path, length(root) + 2)) OVER (PARTITION BY root) AS first_file FROM files")
def rel_path_source_dir(spark, d):
    f = files(spark, d).select("root", paths.source_dir(F.col("root")).alias("source_dir"), paths.rel_path(F.col("root"), F.col("path")).alias("p"))
    return f.groupBy("root", "source_dir").agg(F.min("p").alias("first_file"))


@query(f"WITH {CANDIDATES}, {CHUNKED.format(size=1000, source='candidates')} SELECT * FROM scanned")
def chunk_files(spark, d):
    return chunks.chunk_files(candidates(spark, d), 1000)


@query(f"WITH named AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS source_file, lang AS source_dir, text AS content, strlen(text) AS length FROM documents), {CHUNKED.format(size=300, source='named')} SELECT source_file, chunk_index, chunk, length(chunk) AS size FROM chunked")
def chunk_text(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_file"), F.posexplode(text.chunk_text(F.col("text"), 300)).alias("chunk_index", "chunk")).withColumn("size", F.char_length("chunk"))


@query("""WITH c AS (SELECT 'd' || (doc_id // 2) AS source_file, lang AS source_dir, doc_id % 2 AS chunk_index, text FROM documents)
SELECT source_dir || '/' || source_file || '#chunk' || chunk_index AS id, 'File: ' || source_file || chr(10) || chr(10) || text AS content, substr(sha256(text), 1, 16) AS content_hash,
 map_extract_value(m, 'chunk_index') AS meta_index, map_extract_value(m, 'chunk_version') AS meta_version, map_extract_value(m, 'source_file') AS meta_file
FROM (SELECT *, MAP {'source_file': source_file, 'source_dir': source_dir, 'chunk_index': CAST(chunk_index AS VARCHAR), 'chunk_version': 'v2'} AS m FROM c)""")
def chunk_records(spark, d):
    c = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string")).alias("source_file"), F.col("lang").alias("source_dir"), (F.col("doc_id") % 2).alias("chunk_index"), "text", text.content_hash(F.col("text")).alias("content_hash"), F.lit("v2").alias("chunk_version"))
    m = chunks.chunk_meta(c)
    return c.select(text.chunk_doc_id(F.col("source_dir"), F.col("source_file"), F.col("chunk_index")).alias("id"), text.content_prefix(F.col("source_file"), F.col("text")).alias("content"), "content_hash", m["chunk_index"].alias("meta_index"), m["chunk_version"].alias("meta_version"), m["source_file"].alias("meta_file"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '/' || doc_id)) AS h FROM documents)""")
def point_uuid(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.point_uuid(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages)
SELECT page_id, regexp_replace(host, '[^A-Za-z0-9_-]', '', 'g') AS project, 'project_' || regexp_replace(host, '[^A-Za-z0-9_-]', '', 'g') AS collection,
 CASE WHEN regexp_replace(regexp_replace(host, '[a-z.]', '', 'g'), '[^A-Za-z0-9_-]', '', 'g') = '' THEN substr(sha256(regexp_replace(host, '[a-z.]', '', 'g')), 1, 16) ELSE regexp_replace(host, '[^0-9_-]', '', 'g') END AS odd FROM h""")
def sanitize_project(spark, d):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    p = _t(spark, d, "pages").select("page_id", text.sanitize_project(host).alias("project"), text.collection_name(host).alias("collection"), text.sanitize_project(F.regexp_replace(host, "[a-z.]", "")).alias("odd"))
    return p.where(text.project_of_collection(F.col("collection")) == F.col("project"))


# ---- stored points ----


@query(f"""WITH {POINTS} SELECT project_id, id, doc_id, source_file, chunk_index, substr(content, 1, 200) AS preview, lang, bucket FROM points""")
def point_info(spark, d):
    p = points(spark, d)
    full = p.withColumn("meta", chunks.override(F.col("meta"), F.create_map(*(x for k in ("doc_id", "source_file", "chunk_index") for x in (F.lit(k), F.col(k))))))
    info = chunks.point_info(full)
    return info.where(~F.array_contains(F.map_keys("meta"), "content") & ~F.array_contains(F.map_keys("meta"), "doc_id")).select("project_id", "id", "doc_id", "source_file", "chunk_index", "preview", F.col("meta")["lang"].alias("lang"), F.col("meta")["bucket"].alias("bucket"))


@query(f"WITH {POINTS} SELECT project_id, id, source_file FROM points WHERE project_id = (SELECT min(source) FROM documents) AND lang = 'en' AND bucket = 'b0'")
def list_points(spark, d):
    return chunks.list_points(points(spark, d), _first_project(spark, d), {"lang": "en", "bucket": "b0"}).select("project_id", "id", "source_file")


def _first_project(spark: SparkSession, d: str) -> Column:
    return _t(spark, d, "documents").agg(F.min("source")).scalar()


@query(f"WITH {POINTS} SELECT id FROM points WHERE project_id = (SELECT min(source) FROM documents) AND bucket = 'b0'")
def list_point_ids(spark, d):
    return chunks.list_point_ids(points(spark, d), _first_project(spark, d), {"bucket": "b0"})


@query(f"WITH {POINTS} SELECT project_id, id, source_file, CAST(chunk_index AS INTEGER) AS chunk_index FROM points ORDER BY source_file, chunk_index, id")
def order_points(spark, d):
    return chunks.order_points(points(spark, d)).select("project_id", "id", "source_file", F.col("chunk_index").cast("int").alias("chunk_index"))


@query(f"WITH {POINTS} SELECT project_id, doc_id AS id, content, lang FROM points")
def export_points(spark, d):
    return chunks.export_points(points(spark, d)).select("project_id", "id", "content", F.col("meta")["lang"].alias("lang"))


@query(f"WITH {POINTS} SELECT id, CASE WHEN n % 2 = 0 THEN 'mine' ELSE CASE WHEN n % 3 = 0 THEN 'unknown' ELSE 'm1' END END AS embed_model, '64' AS embed_dim, lang FROM points")
def inject_embed_meta(spark, d):
    p = points(spark, d)
    n = F.col("id").cast("long")
    meta = F.when(n % 2 == 0, chunks.override(F.col("meta"), F.create_map(F.lit("embed_model"), F.lit("mine")))).otherwise(F.col("meta"))
    m = chunks.strip_text(chunks.inject_embed_meta(meta, F.when(n % 3 == 0, "").otherwise("m1"), F.lit(64)))
    return p.select("id", m["embed_model"].alias("embed_model"), m["embed_dim"].alias("embed_dim"), m["lang"].alias("lang"))


@query("SELECT doc_id FROM documents ORDER BY source, doc_id OFFSET 40 LIMIT 20")
def paginate(spark, d):
    return chunks.paginate(_t(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], 40, 20).select("doc_id")


# ---- incremental sync ----


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored chunks of all files, files of the second version, their chunks): a tenth of the files is gone, a tenth has changed."""
    first = candidates(spark, d)
    now = first.where("doc_id % 7 <> 2").withColumn("content", F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    return chunks.chunk_files(first, 1000), now, chunks.chunk_files(now, 1000)


VERSIONS = (
    CANDIDATES
    + ", "
    + CHUNKED.format(size=1000, source="candidates").replace("scanned AS", "stored AS")
    + ", now AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 3 THEN content || ' changed' ELSE content END AS content) FROM candidates WHERE doc_id % 7 <> 2), "
    + CHUNKED.format(size=1000, source="now").replace("pieces", "pieces2").replace("chunked", "chunked2")
)


@query(f"""WITH {VERSIONS} SELECT s.project_id, s.doc_id, s.content_hash, CASE WHEN o.content_hash = s.content_hash THEN 'skipped' WHEN o.doc_id IS NOT NULL THEN 'changed' ELSE 'new' END AS status
FROM scanned s LEFT JOIN stored o ON o.project_id = s.project_id AND o.doc_id = s.doc_id""")
def sync_diff(spark, d):
    stored, _, scanned = _versions(spark, d)
    return sync.sync_diff(scanned, stored).select("project_id", "doc_id", "content_hash", "status")


@query(f"WITH {VERSIONS} SELECT project_id, doc_id, content_hash FROM scanned s WHERE NOT EXISTS (SELECT 1 FROM stored o WHERE o.project_id = s.project_id AND o.doc_id = s.doc_id AND o.content_hash = s.content_hash)")
def new_or_changed(spark, d):
    stored, _, scanned = _versions(spark, d)
    return sync.new_or_changed(scanned, stored).select("project_id", "doc_id", "content_hash")


@query(f"WITH {VERSIONS} SELECT project_id, id FROM stored o WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.project_id = o.project_id AND n.source_file = o.source_file)")
def stale_points(spark, d):
    stored, now, _ = _versions(spark, d)
    return sync.stale_points(stored, now, stored).select("project_id", "id")


@query(f"""WITH {VERSIONS} SELECT project_id, id FROM stored o WHERE chunk_index >= 1 AND EXISTS (SELECT 1 FROM now n WHERE n.project_id = o.project_id AND n.source_file = o.source_file)""")
def orphan_chunks(spark, d):
    stored, _, scanned = _versions(spark, d)
    return sync.orphan_chunks(stored, scanned.where("chunk_index < 1")).select("project_id", "id")


@query(f"""WITH {VERSIONS}, stale AS (SELECT project_id, id FROM stored o WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.project_id = o.project_id AND n.source_file = o.source_file))
SELECT n.project_id, n.files_scanned, coalesce(i.indexed, 0) AS indexed, coalesce(i.skipped, 0) AS skipped, coalesce(g.deleted, 0) AS deleted
FROM (SELECT project_id, count(DISTINCT source_file) AS files_scanned FROM now GROUP BY 1) n
LEFT JOIN (SELECT s.project_id, count(*) FILTER (o.content_hash IS DISTINCT FROM s.content_hash) AS indexed, count(*) FILTER (o.content_hash = s.content_hash) AS skipped
  FROM scanned s LEFT JOIN stored o ON o.project_id = s.project_id AND o.doc_id = s.doc_id GROUP BY 1) i USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS deleted FROM stale GROUP BY 1) g USING (project_id)""")
def sync_result(spark, d):
    stored, now, scanned = _versions(spark, d)
    return sync.sync_corpus(scanned, now, stored, roots=stored)[1]


@query(f"""WITH {VERSIONS} SELECT project_id, id, content_hash FROM scanned UNION ALL
SELECT project_id, id, content_hash FROM stored o WHERE EXISTS (SELECT 1 FROM now n WHERE n.project_id = o.project_id AND n.source_file = o.source_file)
  AND NOT EXISTS (SELECT 1 FROM scanned s WHERE s.project_id = o.project_id AND s.id = o.id)""")
def sync_corpus(spark, d):
    stored, now, scanned = _versions(spark, d)
    return sync.sync_corpus(scanned, now, stored, roots=stored)[0].select("project_id", "id", "content_hash")


@query(f"""WITH {POINTS} SELECT project_id, id, content FROM points WHERE n % 3 <> 0 UNION ALL SELECT project_id, id, content || '!' FROM points WHERE n % 6 = 0 OR n % 3 = 0""")
def upsert_points(spark, d):
    p = points(spark, d).select("project_id", "id", "content")
    incoming = p.where("cast(id as long) % 3 = 0").withColumn("content", F.concat("content", F.lit("!"))).withColumn("at", F.lit(2))
    older = incoming.where("cast(id as long) % 2 = 0").withColumn("content", F.lit("older")).withColumn("at", F.lit(1))
    return sync.upsert_points(p, incoming.unionByName(older), "at")


@query(f"WITH {POINTS} SELECT project_id, id FROM points UNION ALL SELECT project_id, id FROM points WHERE bucket = 'b2'")
def append_points(spark, d):
    p = points(spark, d).select("project_id", "id", F.col("meta")["bucket"].alias("bucket"))
    return sync.append_points(p, p.where("bucket = 'b2'")).select("project_id", "id")


@query(f"WITH {POINTS} SELECT project_id, id FROM points WHERE NOT (bucket = 'b1' AND project_id <> 'src1') AND project_id <> 'src2'")
def delete_points(spark, d):
    p = points(spark, d)
    ids = p.where("meta['bucket'] = 'b1' and project_id <> 'src1'").select("project_id", "id")
    return sync.delete_project(sync.delete_points(p, ids), p.where("project_id = 'src2'").select("project_id")).select("project_id", "id")


@query("SELECT DISTINCT source AS project_id FROM documents UNION SELECT 'fresh'")
def create_project(spark, d):
    have = _t(spark, d, "documents").select(F.col("source").alias("project_id")).distinct()
    asked = have.where("project_id = 'src1'").unionByName(have.limit(1).select(F.lit("fresh").alias("project_id")))
    return sync.create_project(have, asked)


@query("SELECT 'src' || (item_id % 30) AS project_id, count(*) AS requests FROM benchmark WHERE 'src' || (item_id % 30) IN (SELECT source FROM documents) GROUP BY 1")
def project_exists(spark, d):
    asked = _t(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string")).alias("project_id"))
    return sync.project_exists(asked, points(spark, d)).groupBy("project_id").agg(F.count("*").alias("requests"))


# ---- search ----


@query(f"WITH {DENSE.format(k=5)} SELECT query_id, id, round(score, 6) AS score, rank FROM dense")
def topk_dense(spark, d):
    return search.topk_dense(vector_queries(spark, d), vector_chunks(spark, d), 5).select("query_id", "id", _r("score").alias("score"), "rank")


@query(f"""WITH {DENSE.format(k=5)}, far AS (SELECT query_id, id, 1 - list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS score FROM vq JOIN vc USING (project_id) WHERE e IS NOT NULL)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM far QUALIFY rank <= 5""")
def topk_dense_l2(spark, d):
    return search.topk_dense(vector_queries(spark, d), vector_chunks(spark, d), 5, "l2").select("query_id", "id", _r("score").alias("score"), "rank")


ASKED = LEXICAL.replace("FROM vq", "FROM bq")


@query(f"WITH {DENSE.format(k=5)}, {ASKED} SELECT query_id, id, round(score, 6) AS score, rank FROM lexical")
def topk_lexical(spark, d):
    return search.topk_lexical(word_queries(spark, d), vector_chunks(spark, d)).select("query_id", "id", _r("score").alias("score"), "rank")


@query(f"WITH {DENSE.format(k=5)}, {ASKED} SELECT query_id, id, round(score, 6) AS score, rank FROM lexical")
def topk_lexical_index(spark, d):
    """The same from a stored index, which only the queries' terms are read of."""
    chunks_, path = vector_chunks(spark, d), f"{store.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    search.write_index(chunks_, path)
    return search.topk_lexical(word_queries(spark, d), chunks_, index=path).select("query_id", "id", _r("score").alias("score"), "rank")


@query(f"WITH {DENSE.format(k=5)}, {ASKED} SELECT query_id, id FROM matched")
def match_postings(spark, d):
    return search.match_postings(word_queries(spark, d), search.postings(vector_chunks(spark, d)))


@query(f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents) SELECT doc_id, coalesce(list_has_all(ws, ['the', 'and']), false) AS english, coalesce(list_contains(ws, 'der'), false) AS german FROM w")
def lexical_match(spark, d):
    w = _t(spark, d, "documents").select("doc_id", text.tokens(F.coalesce("text", F.lit(""))).alias("ws"))
    return w.select("doc_id", text.lexical_match(F.array(F.lit("the"), F.lit("and")), F.col("ws")).alias("english"), text.lexical_match(text.query_terms(F.lit("DER, der!")), F.col("ws")).alias("german"))


@query(f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents) SELECT doc_id, len(ws) AS n_words, len(list_distinct(ws)) AS n_terms, substr(sha256(array_to_string(ws, ' ')), 1, 16) AS words_hash FROM w")
def tokenize_simple(spark, d):
    w = _t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    return w.select("doc_id", F.size("ws").alias("n_words"), F.size(F.array_distinct("ws")).alias("n_terms"), text.content_hash(F.array_join("ws", " ")).alias("words_hash"))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS hits FROM w GROUP BY term""")
def postings(spark, d):
    index = search.postings(_t(spark, d, "documents").select(F.lit("p").alias("project_id"), F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("hits"))


@query(f"WITH {DENSE.format(k=25)}, {LEXICAL}, {FUSED} SELECT query_id, id, round(score, 6) AS score, in_dense, in_lexical, rank FROM fused")
def hybrid_search(spark, d):
    return search.hybrid_search(vector_queries(spark, d), vector_chunks(spark, d)).select("query_id", "id", _r("score").alias("score"), "in_dense", "in_lexical", "rank")


CAPPED = """found AS (SELECT f.*, c.doc_id, c.content, c.content_hash FROM fused f JOIN vc c USING (id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(doc_id, '^(.+)#[^#]*$', '\\1') ORDER BY rank) AS nth FROM found QUALIFY nth <= 1)"""


@query(f"WITH {DENSE.format(k=25)}, {LEXICAL}, {FUSED}, {CAPPED}, cut AS (SELECT query_id, id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM capped QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5) SELECT * FROM cut")
def cap_per_doc(spark, d):
    return plan.search(vector_queries(spark, d), vector_chunks(spark, d), hybrid=True, max_per_doc=1).select("query_id", "id", "doc_id", "rank")


@query(f"""WITH {DENSE.format(k=25)}, byhash AS (SELECT d.*, c.content, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS n FROM dense d JOIN vc c USING (id) QUALIFY n = 1),
bytext AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rank) AS m FROM byhash QUALIFY m = 1)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM bytext""")
def compress_results(spark, d):
    return plan.search(vector_queries(spark, d), vector_chunks(spark, d), k=25, compress=True).select("query_id", "id", "rank")


RERANKED = """cand AS (SELECT d.query_id, d.id, d.rank - 1 AS cand_pos, c.content, c.doc_id, CASE WHEN d.query_id % 100 = 0 THEN NULL ELSE 1.0 / (1 + length(c.content)) END AS s, d.score FROM dense d JOIN vc c USING (id)),
moved AS (SELECT *, s IS NOT NULL AS reranked, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC NULLS LAST, cand_pos) AS rank FROM cand QUALIFY rank <= 5)"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("query_id") % 100 != 0, 1 / (1 + F.char_length("content")))
    return plan.search(vector_queries(spark, d), vector_chunks(spark, d), reranker=score)


@query(f"WITH {DENSE.format(k=25)}, {RERANKED} SELECT query_id, id, rank, cand_pos, reranked, round(coalesce(s, score), 6) AS score FROM moved")
def rerank(spark, d):
    return _reranked(spark, d).select("query_id", "id", "rank", "cand_pos", "reranked", _r("score").alias("score"))


@query(f"WITH {DENSE.format(k=25)}, {RERANKED} SELECT query_id, count(*) FILTER (cand_pos <> rank - 1) AS rerank_moved FROM moved GROUP BY 1")
def rerank_moved(spark, d):
    return search.rerank_moved(_reranked(spark, d))


@query(f"""WITH {DENSE.format(k=25)}, {LEXICAL}, {FUSED}, cand AS (SELECT f.*, f.rank - 1 AS cand_pos, c.content, c.doc_id, CASE WHEN f.query_id % 100 = 0 THEN NULL ELSE 1.0 / (1 + length(c.content)) END AS s FROM fused f JOIN vc c USING (id)),
final AS (SELECT *, s IS NOT NULL AS reranked, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC NULLS LAST, cand_pos) AS place FROM cand QUALIFY place <= 5),
m AS (SELECT query_id, count(*) AS candidates, count(*) FILTER (in_dense) AS dense_count, count(*) FILTER (in_lexical) AS lexical_count FROM fused GROUP BY 1),
f AS (SELECT query_id, count(*) AS results, bool_or(reranked) AS reranked, count(*) FILTER (reranked AND cand_pos <> place - 1) AS rerank_moved, arg_min(doc_id, place) AS top_doc_id, round(arg_min(coalesce(s, score), place), 6) AS top_score FROM final GROUP BY 1)
SELECT query_id, true AS hybrid, reranked, candidates, results, dense_count, lexical_count, rerank_moved, lexical_count = 0 AS hybrid_fallback, top_doc_id, top_score FROM m JOIN f USING (query_id)""")
def search_with_log(spark, d):
    score = F.when(F.col("query_id") % 100 != 0, 1 / (1 + F.char_length("content")))
    asked = vector_queries(spark, d).withColumn("no_log", F.lit(False))
    _, metric, logged = plan.search_with_log(asked, vector_chunks(spark, d), hybrid=True, reranker=score)
    both = metric.join(logged.select("query_id", "top_doc_id", _r("top_score").alias("top_score")), "query_id")
    return both.select("query_id", "hybrid", "reranked", "candidates", "results", "dense_count", "lexical_count", "rerank_moved", "hybrid_fallback", "top_doc_id", "top_score")


@query(f"""WITH {DENSE.format(k=5)} SELECT query_id, count(d.id) AS results, round(max(score), 6) AS top_score FROM vq LEFT JOIN dense d USING (query_id) WHERE query_id % 150 <> 0 GROUP BY 1""")
def log_rows(spark, d):
    """A query is kept out of the log only if it says so: of three, one says so, one does not, and one says nothing."""
    n = F.col("query_id") / 50 % 3
    asked = vector_queries(spark, d).withColumn("no_log", F.when(n == 0, True).when(n == 1, False))
    found = search.topk_dense(asked, vector_chunks(spark, d), 5).withColumns({"doc_id": F.col("id"), "reranked": F.lit(False), "cand_pos": F.col("rank") - 1})
    return plan.log_rows(asked, found)[1].select("query_id", "results", _r("top_score").alias("top_score"))


@query(f"""WITH {DENSE.format(k=25)}, h AS (SELECT query_id, id, rank, CASE WHEN rank % 2 = 1 THEN rank + 2 ELSE rank - 1 END AS pos FROM dense WHERE rank <= 5)
SELECT d.query_id, d.id, round(1.0 / h.rank, 6) AS score, row_number() OVER (PARTITION BY d.query_id ORDER BY h.rank) AS rank FROM h JOIN dense d ON d.query_id = h.query_id AND d.rank = h.pos + 1 AND d.rank <= 5""")
def attach_rerank(spark, d):
    found = search.topk_dense(vector_queries(spark, d), vector_chunks(spark, d), 5)
    pos = F.when(F.col("rank") % 2 == 1, F.col("rank") + 2).otherwise(F.col("rank") - 1)
    hits = found.select("query_id", pos.alias("cand_pos"), (1 / F.col("rank")).alias("relevance_score"))
    return search.attach_rerank(found, hits).select("query_id", "id", _r("score").alias("score"), "rank")


@query(f"""WITH {DENSE.format(k=5)} SELECT query_id, string_agg('[score ' || format('{{:.3f}}', round(score, 3)) || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context FROM dense JOIN vc USING (id) GROUP BY 1""")
def retrieve_context(spark, d):
    return plan.retrieve_context(vector_queries(spark, d), vector_chunks(spark, d))


@query(f"WITH {DENSE.format(k=5)} SELECT query_id, count(*) AS n, string_agg(rank || ':' || id, ',' ORDER BY rank) AS refs FROM dense GROUP BY 1")
def context_refs(spark, d):
    r = search.context_refs(search.topk_dense(vector_queries(spark, d), vector_chunks(spark, d), 5))
    return r.select("query_id", F.size("refs").alias("n"), F.array_join(F.transform("refs", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["id"])), ",").alias("refs"))


@query(f"""WITH {DENSE.format(k=25)}, {LEXICAL}, {FUSED} SELECT query_id, count(*) AS candidates, count(*) FILTER (in_dense) AS dense_count, count(*) FILTER (in_lexical) AS lexical_count, least(count(*), 5) AS results, count(*) FILTER (in_lexical) = 0 AS hybrid_fallback,
round(count(*) FILTER (in_dense) / (count(*) FILTER (in_dense) + count(*) FILTER (in_lexical)), 6) AS dense_share, round(count(*) FILTER (in_lexical) / (count(*) FILTER (in_dense) + count(*) FILTER (in_lexical)), 6) AS lexical_share FROM fused GROUP BY 1""")
def query_composition(spark, d):
    found = search.hybrid_search(vector_queries(spark, d), vector_chunks(spark, d))
    made = search.query_composition(found, search.truncate_k(found))
    share = metrics.retrieval_breakdown(made)
    return made.join(share, "query_id").withColumns({"dense_share": _r("dense_share"), "lexical_share": _r("lexical_share")})


@query("""SELECT doc_id, regexp_replace(text, '(?i)(der|the)', '<mark>\\1</mark>', 'g') AS shown, CASE WHEN length(text) / 5000.0 >= 0.75 THEN 'good' WHEN length(text) / 5000.0 >= 0.5 THEN 'warn' ELSE 'faint' END AS band FROM documents""")
def highlight(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.highlight(F.col("text"), F.array(F.lit("der"), F.lit("a"), F.lit("the"))).alias("shown"), text.score_band(F.char_length("text") / 5000.0).alias("band"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 WHEN doc_id % 3 > 0 THEN doc_id % 3 ELSE 5 END AS k, greatest(CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 ELSE 25 END, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 WHEN doc_id % 3 > 0 THEN doc_id % 3 ELSE 5 END) AS recall FROM documents""")
def resolve_search_opts(spark, d):
    i = F.col("doc_id")
    return search.resolve_options(_t(spark, d, "documents").select("doc_id", (i % 4).alias("k"), (i % 3).alias("limit"), (i % 7).alias("recall"))).select("doc_id", "k", "recall")


@query("SELECT count(*) AS queries, true AS good FROM embeddings WHERE vec_id % 50 = 0")
def topk_approx(spark, d):
    """Whether a search in the stored inverted file finds nine tenths of the exact nearest."""
    asked, known = vector_queries(spark, d), vector_chunks(spark, d)
    near, exact = search.topk_approx(asked, known, 5), search.topk_dense(asked, known, 5)
    met = exact.join(near.select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("found", F.lit(0))) / F.count("*") >= 0.9).alias("good"))


# ---- counts, latencies, logs, quality ----


@query(f"WITH {POINTS} SELECT project_id, count(*) AS chunk_count FROM points GROUP BY 1")
def list_projects(spark, d):
    return metrics.list_projects(points(spark, d))


@query("SELECT DISTINCT source AS project_id FROM documents ORDER BY 1")
def list_project_ids(spark, d):
    return metrics.list_project_ids(points(spark, d))


@query(f"WITH {POINTS}, asked AS (SELECT DISTINCT 'src' || (item_id % 25) AS project_id FROM benchmark) SELECT a.project_id, count(p.id) AS chunk_count FROM asked a LEFT JOIN points p USING (project_id) GROUP BY 1")
def count_points(spark, d):
    asked = _t(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("project_id")).distinct()
    return metrics.count_points(points(spark, d), asked)


@query(f"WITH {POINTS}, asked AS (SELECT DISTINCT 'src' || (item_id % 25) AS project_id FROM benchmark) SELECT a.project_id, count(p.id) AS chunk_count, count(p.id) > 0 AS found FROM asked a LEFT JOIN points p USING (project_id) GROUP BY 1")
def get_project(spark, d):
    asked = _t(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("project_id")).distinct()
    return metrics.get_project(points(spark, d), asked)


@query(f"WITH {POINTS} SELECT count(DISTINCT project_id) AS total_projects, count(*) AS total_chunks, 'm1' AS embed_model FROM points")
def stats(spark, d):
    return metrics.stats(points(spark, d), "m1")


@query(f"""WITH {POINTS}, n AS (SELECT project_id, coalesce(nullif(source_file, ''), '(unknown)') AS source_file, count(*) AS chunks FROM points GROUP BY 1, 2)
SELECT project_id, source_file, chunks, row_number() OVER (PARTITION BY project_id ORDER BY chunks DESC, source_file) AS place, round(chunks / max(chunks) OVER (PARTITION BY project_id), 6) AS share FROM n QUALIFY place <= 8""")
def chunk_distribution(spark, d):
    return metrics.chunk_distribution(points(spark, d)).withColumn("share", _r("share"))


@query(f"WITH {POINTS} SELECT project_id, count(DISTINCT source_file) AS files FROM points GROUP BY 1")
def unique_files(spark, d):
    return metrics.unique_files(points(spark, d))


RANKS = "SELECT {g}, count(*) AS count, round(avg(latency_ms), 6) AS avg_ms, list_sort(list(latency_ms))[CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p50_ms, list_sort(list(latency_ms))[CAST(floor(0.95 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p95_ms FROM {t} GROUP BY 1"


@query(f"WITH {LOG} {RANKS.format(g='project_id', t='qlog')}")
def latency_summary(spark, d):
    return metrics.latency_summary(log(spark, d), ["project_id"]).withColumn("avg_ms", _r("avg_ms"))


@query(f"WITH {LOG} SELECT count, avg_ms, p50_ms, p95_ms FROM ({RANKS.format(g='1 AS g', t='qlog')})")
def latency_total(spark, d):
    return metrics.latency_summary(log(spark, d)).withColumn("avg_ms", _r("avg_ms"))


@query(f"""WITH {LOG}, all_rows AS ({RANKS.format(g='1 AS g', t='qlog')}), last AS (SELECT * FROM qlog ORDER BY ts DESC, id DESC LIMIT 1)
SELECT a.count, a.avg_ms, a.p50_ms, a.p95_ms, CAST((SELECT sum(length(text)) FILTER (doc_id % 2 = 0) FROM documents) AS BIGINT) AS embed_tokens, CAST((SELECT sum(length(text)) FILTER (doc_id % 2 = 1) FROM documents) AS BIGINT) AS rerank_tokens,
  CAST((SELECT sum(length(text)) FROM documents) AS BIGINT) AS total_tokens, 'parquet' AS backend, l.reranked AS last_reranked, l.results AS last_results FROM all_rows a, last l""")
def metrics_snapshot(spark, d):
    return metrics.metrics_snapshot(log(spark, d), _usage(spark, d), "parquet").withColumn("avg_ms", _r("avg_ms"))


@query(f"WITH {LOG} SELECT true AS enabled, count(*) AS n, max(id) AS newest, min(id) AS oldest FROM (SELECT id FROM qlog WHERE NOT no_log ORDER BY id DESC LIMIT 50)")
def recent_report(spark, d):
    r = metrics.recent_report(spark, metrics.logged(log(spark, d)))
    return r.select("enabled", F.size("queries").cast("long").alias("n"), F.col("queries")[0]["id"].alias("newest"), F.element_at("queries", -1)["id"].alias("oldest"))


@query(f"WITH {LOG}, ring AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ts DESC, id DESC) AS n FROM qlog QUALIFY n <= 512), r AS ({RANKS.format(g='query', t='ring')}) SELECT r.query, r.avg_ms, r.p50_ms, r.p95_ms, t.total FROM r JOIN (SELECT query, count(*) AS total FROM qlog GROUP BY 1) t USING (query)")
def latency_ring(spark, d):
    return metrics.latency_ring(log(spark, d), ["query"]).withColumn("avg_ms", _r("avg_ms"))


@query(f"WITH {LOG} SELECT project_id, id, results, reranked FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, id DESC) AS n FROM qlog) WHERE n = 1")
def last_query(spark, d):
    return metrics.last_query(log(spark, d), ["project_id"], ["id", "results", "reranked"])


@query("SELECT CAST(sum(length(text)) FILTER (doc_id % 2 = 0) AS BIGINT) AS embed_tokens, CAST(sum(length(text)) FILTER (doc_id % 2 = 1) AS BIGINT) AS rerank_tokens, CAST(sum(length(text)) AS BIGINT) AS total_tokens FROM documents")
def token_usage(spark, d):
    return metrics.token_usage(_usage(spark, d))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "embed").otherwise("rerank").alias("kind"), F.char_length("text").alias("tokens"))


@query(f"WITH {LOG} SELECT id, project_id, query FROM qlog WHERE NOT no_log AND id > (SELECT max(id) - 500 FROM qlog WHERE NOT no_log)")
def prune_log(spark, d):
    return metrics.prune_log(metrics.logged(log(spark, d)), 500).select("id", "project_id", "query")


@query(f"WITH {LOG} SELECT id, query, results FROM qlog WHERE NOT no_log ORDER BY id DESC LIMIT 50")
def recent_queries(spark, d):
    return metrics.recent_queries(metrics.logged(log(spark, d))).select("id", "query", "results")


@query(f"WITH {LOG} SELECT id, query FROM qlog WHERE results = 0 OR top_score < 0.05")
def zero_result_queries(spark, d):
    return metrics.zero_result_queries(log(spark, d), 0.05).select("id", "query")


@query("SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def activity_by_type(spark, d):
    return metrics.activity_by_type(_t(spark, d, "events"), "event_type")


@query(f"""WITH {DENSE.format(k=25)}, r AS (SELECT d.*, length(content) AS size, regexp_replace(doc_id, '^(.+)#[^#]*$', '\\1') AS root FROM dense d JOIN vc USING (id)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, root ORDER BY rank) AS nth FROM r)
SELECT query_id, count(*) AS slots, count(DISTINCT root) AS documents, round(sum(CASE WHEN nth > 1 THEN size ELSE 0 END) / greatest(sum(size), 1), 6) AS repeat_text_share FROM n GROUP BY 1""")
def distinct_doc_coverage(spark, d):
    return metrics.coverage(plan.search(vector_queries(spark, d), vector_chunks(spark, d), k=25)).withColumn("repeat_text_share", _r("repeat_text_share"))


ACCEPT = "accept AS (SELECT query_id, 'd' || (query_id // 4 + i) || '#' || (i % 4) AS doc_id FROM (SELECT query_id, unnest([0, 1, 2, 3]) AS i FROM vq)), best AS (SELECT a.query_id, min(d.rank) AS best FROM accept a LEFT JOIN vc c ON c.doc_id = a.doc_id LEFT JOIN dense d ON d.query_id = a.query_id AND d.id = c.id GROUP BY 1)"


def _accept(spark: SparkSession, d: str) -> DataFrame:
    q = vector_queries(spark, d).select("query_id", F.explode(F.array(*map(F.lit, range(4)))).alias("i"))
    return q.select("query_id", F.concat(F.lit("d"), (F.floor(F.col("query_id") / 4) + F.col("i")).cast("string"), F.lit("#"), (F.col("i") % 4).cast("string")).alias("acceptable_doc_id"))


@query(f"WITH {DENSE.format(k=60)}, {ACCEPT} SELECT count(*) AS questions, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3 FROM best")
def hit_at_k(spark, d):
    found = search.topk_dense(vector_queries(spark, d), vector_chunks(spark, d), 60, columns=("doc_id",))
    return metrics.hit_at_k(found, _accept(spark, d)).withColumns({"hit_at_1": _r("hit_at_1"), "hit_at_3": _r("hit_at_3")})


@query(f"WITH {DENSE.format(k=60)}, {ACCEPT} SELECT recall, round(avg(CASE WHEN best <= recall THEN 1.0 ELSE 0.0 END), 6) AS hit FROM best, (SELECT unnest([12, 25, 40, 60]) AS recall) GROUP BY 1")
def recall_sweep(spark, d):
    found = search.topk_dense(vector_queries(spark, d), vector_chunks(spark, d), 60, columns=("doc_id",))
    return metrics.recall_sweep(found, _accept(spark, d)).withColumn("hit", _r("hit"))


@query("""SELECT run_id, batch, pct FROM (SELECT user_id AS run_id, event_id AS batch, CAST(floor(event_id * 100 / 10000) AS INTEGER) AS pct, lag(CAST(floor(event_id * 100 / 10000) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> pct""")
def migration_progress(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("batch"), F.col("event_id").alias("done"), F.lit(10000).alias("total"))
    return metrics.progress(e).select("run_id", "batch", "pct")


# ---- write contract ----

CONTRACT = guard.Contract(("src1", "src2", "src3", "src4"), 3000, ("quality", "bucket"), {"quality": ("1",), "bucket": ("b0", "b1", "b2")}, 25)


def _memory(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("quality"))
    p = points(spark, d).join(labels, "id", "left")
    meta = F.map_filter(F.create_map(F.lit("quality"), "quality", F.lit("bucket"), F.when(F.col("id").cast("long") % 9 == 0, "  ").otherwise(F.col("meta")["bucket"])), lambda _, v: v.isNotNull())
    return p.select("project_id", "id", "content", meta.alias("meta"), (F.col("id").cast("long") % 6).alias("batch"))


MEMORY = (
    POINTS
    + """, m AS (SELECT project_id, id, content, n % 6 AS batch, CAST(quality AS VARCHAR) AS quality, CASE WHEN n % 9 = 0 THEN '' ELSE bucket END AS bucket FROM points LEFT JOIN labels l ON l.doc_id = n),
v AS (SELECT project_id, id, batch, unnest(list_filter([
  CASE WHEN length(content) > 3000 THEN {'rule': 'max_chars', 'detail': CAST(length(content) AS VARCHAR)} END,
  CASE WHEN quality IS NULL THEN {'rule': 'required_meta', 'detail': 'quality'} END, CASE WHEN bucket = '' THEN {'rule': 'required_meta', 'detail': 'bucket'} END,
  CASE WHEN quality <> '1' THEN {'rule': 'enum_meta', 'detail': 'quality=' || quality} END, CASE WHEN bucket NOT IN ('', 'b0', 'b1', 'b2') THEN {'rule': 'enum_meta', 'detail': 'bucket=' || bucket} END],
  lambda x: x IS NOT NULL)) AS x FROM m WHERE project_id IN ('src1', 'src2', 'src3', 'src4')),
found AS (SELECT project_id, id, batch, x.rule AS rule, x.detail AS detail FROM v)"""
)


@query(f"WITH {MEMORY} SELECT project_id, id, rule, detail FROM found")
def guard_violations(spark, d):
    return guard.violations(_memory(spark, d), CONTRACT)


@query(f"WITH {MEMORY} SELECT project_id, id, batch, NOT EXISTS (SELECT 1 FROM found f WHERE f.project_id = m.project_id AND f.batch = m.batch) AS accepted FROM m")
def guard_split(spark, d):
    return guard.guard_split(_memory(spark, d), CONTRACT, "batch").select("project_id", "id", "batch", "accepted")


@query(f"WITH {MEMORY} SELECT rule, count(*) AS violations, count(DISTINCT project_id || '/' || id) AS documents FROM found GROUP BY 1")
def violation_counts(spark, d):
    return guard.violation_counts(guard.violations(_memory(spark, d), CONTRACT))


@query(f"""WITH {MEMORY}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id, rule, detail) AS n FROM found),
t AS (SELECT project_id, count(*) AS documents FROM m GROUP BY 1)
SELECT project_id, any_value(t.documents) AS documents, count(DISTINCT id) AS bad_documents, greatest(count(*) - 10, 0) AS more, string_agg(id || ' ' || rule || ' ' || detail, '; ' ORDER BY n) FILTER (n <= 10) AS shown FROM n JOIN t USING (project_id) GROUP BY 1""")
def guard_report(spark, d):
    docs = _memory(spark, d)
    return guard.guard_report(docs, guard.violations(docs, CONTRACT)).withColumn("shown", F.array_join("shown", "; "))


@query(f"WITH {POINTS} SELECT bucket AS request_id, project_id, count(*) AS points, project_id NOT IN ('src1', 'src2', 'src3', 'src4') OR count(*) <= 25 AS allowed FROM points GROUP BY 1, 2")
def guard_delete_cap(spark, d):
    return guard.delete_refusals(points(spark, d).select(F.col("meta")["bucket"].alias("request_id"), "project_id"), CONTRACT)


@query("SELECT source AS project_id, source NOT IN ('src1', 'src2', 'src3', 'src4') AS allowed, count(*) AS requests FROM documents GROUP BY 1, 2")
def guard_scan_refusal(spark, d):
    asked = _t(spark, d, "documents").select(F.col("source").alias("project_id"))
    return guard.scan_refusals(asked, CONTRACT).groupBy("project_id", "allowed").agg(F.count("*").alias("requests"))


@query("SELECT DISTINCT source AS project_id, source NOT IN ('src1', 'src2', 'src3', 'src4') AS allowed FROM documents")
def guard_project_delete(spark, d):
    return guard.project_delete_refusals(_t(spark, d, "documents").select(F.col("source").alias("project_id")).distinct(), CONTRACT)


# ---- documents handed in, embedding, the store ----

#: A model of two numbers, so that SQL can say what it gives.
EMBEDDER = embed.Embedder(lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts], "counts", 2, query_fn=lambda texts: [[float(len(t)), 0.0] for t in texts], count_tokens=lambda t: t.count(" ") + 1)


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS FLOAT) AS e0, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS FLOAT) AS e1, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS BIGINT) AS tokens FROM documents")
def embed_documents(spark, d):
    e = embed.embed_documents(_t(spark, d, "documents").select("doc_id", "text"), EMBEDDER, "text")
    return e.select("doc_id", F.col("embedding")[0].alias("e0"), F.col("embedding")[1].alias("e1"), "tokens")


@query("SELECT item_id AS query_id, CAST(length(coalesce(text, '')) AS FLOAT) AS e0, CAST(0 AS FLOAT) AS e1 FROM benchmark")
def embed_queries(spark, d):
    e = embed.embed_queries(word_queries(spark, d), EMBEDDER)
    return e.select("query_id", F.col("query_vec")[0].alias("e0"), F.col("query_vec")[1].alias("e1"))


@query(f"WITH {POINTS} SELECT project_id, doc_id AS id, CAST(length(content) AS FLOAT) AS e0, 'counts' AS embed_model, '2' AS embed_dim, lang FROM points")
def reembed(spark, d):
    old = points(spark, d).withColumn("meta", chunks.inject_embed_meta(F.col("meta"), F.lit("old"), F.lit(7)))
    r = embed.reembed(old, EMBEDDER)
    return r.select("project_id", "id", F.col("embedding")[0].alias("e0"), *(F.col("meta")[k].alias(k) for k in ("embed_model", "embed_dim", "lang")))


@query(f"""WITH {MEMORY}, taken AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.project_id = m.project_id AND f.batch = m.batch))
SELECT project_id, id, CAST(length(content) AS FLOAT) AS e0, 'counts' AS embed_model FROM taken
UNION ALL SELECT project_id, id, CAST(-1 AS FLOAT), 'old' FROM points p WHERE n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.project_id = p.project_id AND t.id = p.id)""")
def ingest_documents(spark, d):
    old = points(spark, d).where("cast(id as long) % 2 = 0").select("project_id", "id", "content", F.create_map(F.lit("embed_model"), F.lit("old")).alias("meta"), F.array(F.lit(-1.0).cast("float")).alias("embedding"))
    after, _ = ingest.ingest_documents(_memory(spark, d), old, EMBEDDER, CONTRACT, "batch")
    return after.select("project_id", "id", F.col("embedding")[0].alias("e0"), F.col("meta")["embed_model"].alias("embed_model"))


@query(f"""WITH {POINTS} SELECT n, CASE WHEN n % 5 = 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) ELSE doc_id END AS id
FROM (SELECT n, doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(content)) AS h FROM points)""")
def fallback_id(spark, d):
    n = F.col("id").cast("long")
    return points(spark, d).select(n.alias("n"), text.fallback_id(F.when(n % 5 != 0, F.col("doc_id")).otherwise(""), F.col("content")).alias("id"))


@query(f"WITH {POINTS} SELECT project_id, count(*) AS points, count(DISTINCT content_hash) AS texts, min(id) AS first FROM points WHERE project_id IN (SELECT source FROM documents WHERE doc_id < 50) GROUP BY 1")
def write_read_chunks(spark, d):
    """The collection written and read back, by the projects that the first fifty documents name."""
    wanted = [r[0] for r in _t(spark, d, "documents").where("doc_id < 50").select("source").distinct().collect()]
    base = _written(spark, points(spark, d), 200)
    return collection.read_chunks(spark, base, wanted).groupBy("project_id").agg(F.count("*").alias("points"), F.count_distinct("content_hash").alias("texts"), F.min("id").alias("first"))


def _written(spark: SparkSession, chunks: DataFrame, rows: int) -> str:
    """A collection of its own for a query, in the shared folder."""
    base = _fresh(spark, "collection")
    collection.write_chunks(chunks, base, rows)
    return base


@query(f"""WITH {POINTS}, kept AS (SELECT project_id, id, content, lang FROM points WHERE n % 50 <> 0 AND n % 70 <> 3 AND project_id <> 'src7'
  UNION ALL SELECT project_id, id, content || '!', lang FROM points WHERE n % 50 = 0 AND project_id <> 'src7'
  UNION ALL SELECT project_id, 'new' || id, content, lang FROM points WHERE n % 100 = 0 AND project_id <> 'src7') SELECT * FROM kept""")
def upsert_chunks(spark, d):
    """A fiftieth of the stored points comes again with other content, some come in, some go, and a project goes; old files are taken away."""
    p = points(spark, d)
    base = _written(spark, p, 200)
    n = F.col("id").cast("long")
    again = p.where(n % 50 == 0).withColumn("content", F.concat("content", F.lit("!")))
    new = p.where(n % 100 == 0).withColumn("id", F.concat(F.lit("new"), "id"))
    collection.upsert_chunks(again.unionByName(new), base, gone=p.where(n % 70 == 3), rows=200)
    collection.delete_projects(spark, base, ["src7"])
    collection.collect_old(spark, base)
    return collection.read_chunks(spark, base).select("project_id", "id", "content", F.col("meta")["lang"].alias("lang"))


@query("SELECT doc_id FROM documents ORDER BY source, doc_id OFFSET 777 LIMIT 40")
def paginate_stored(spark, d):
    """A page far down, of rows stored in order."""
    path, order = _fresh(spark, "pages"), ["source", "doc_id"]
    pages.write_pages(_t(spark, d, "documents").select(*order, "lang"), order, path, 16)
    return pages.read_page(spark, path, order, 777, 40).select("doc_id")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{store.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT row_number() OVER (ORDER BY event_id % 2, event_id) AS id, event_id AS metric, value AS latency_ms FROM events")
def append_query_metrics(spark, d):
    """Events as query metrics in two batches, of which the second comes twice."""
    rows, path = _t(spark, d, "events").select(F.col("event_id").alias("metric"), F.col("value").alias("latency_ms"), F.lit(0).cast("long").alias("id")), _fresh(spark, "metrics")
    for rest in (0, 1, 1):
        store.append_batch(rows.where(F.col("metric") % 2 == rest), path, f"batch {rest}", ["metric"])
    return store.read_batches(spark, path, "id long, metric long, latency_ms double")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS id, event_type AS query FROM events WHERE event_id % 3 <> 0")
def append_query_log(spark, d):
    """Events as a log that is switched on, without the synthetic ones."""
    path = _fresh(spark, "log")
    entries = log(spark, d).select("ts", F.col("id").alias("event"), "query", "no_log")
    store.append_query_log(entries, path, "off")
    store.append_query_log(entries, path, "all", True, ("ts", "event"))
    return store.read_query_log(spark, path, "id long, query string")


@query(f"WITH {POINTS} SELECT project_id, CASE WHEN coalesce(doc_id, '') = '' THEN id ELSE doc_id END AS id, CAST(length(content) AS FLOAT) AS e0, 'counts' AS embed_model, 10 AS batches FROM points")
def migrate_resumed(spark, d):
    """A migration in ten batches that is cut off after three and then goes on."""
    path = _fresh(spark, "migration")
    migrate.start(points(spark, d), path, 10)
    done = migrate.run(spark, path, EMBEDDER, 3) + migrate.run(spark, path, EMBEDDER)
    out = migrate.migrated(spark, path)
    return out.select("project_id", "id", F.col("embedding")[0].alias("e0"), F.col("meta")["embed_model"].alias("embed_model"), F.lit(done).alias("batches"))


@query("""WITH f AS (SELECT source, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY source)
SELECT source AS project_id, strlen(content) AS length, CASE WHEN strlen(content) <= 512000 THEN substr(sha256(content), 1, 16) END AS content_hash FROM f""")
def scan_corpus(spark, d):
    """Documents as files, one for each source, found and read again by a scan of their folder."""
    root = _fresh(spark, "files")
    rows = _t(spark, d, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(root)
    found = corpus.scan_corpus(spark, root).where(F.col("path").endswith(".txt"))
    return found.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("project_id"), "length", text.content_hash(F.col("content")).alias("content_hash"))


@query("SELECT 'u' || (user_id % 7) AS project_id, count(*) AS count, true AS p50_near, true AS p95_near FROM events GROUP BY 1")
def approx_latency(spark, d):
    """Whether the sketch's values have ranks within a hundredth of the exact ones."""
    rows = log(spark, d).select("project_id", "latency_ms")
    guess = metrics.approx_latency(rows, ["project_id"], accuracy=1000)
    placed = rows.join(guess.drop("count"), "project_id").groupBy("project_id").agg(F.count("*").alias("count"), *(x for p in ("p50", "p95") for x in (F.count_if(F.col("latency_ms") < F.col(f"{p}_ms")).alias(f"{p}_below"), F.count_if(F.col("latency_ms") <= F.col(f"{p}_ms")).alias(f"{p}_upto"))))
    good = lambda p, share: (F.col(f"{p}_below") <= F.col("count") * (share + 0.01)) & (F.col(f"{p}_upto") >= F.col("count") * (share - 0.01))
    return placed.select("project_id", "count", good("p50", 0.5).alias("p50_near"), good("p95", 0.95).alias("p95_near"))


# ---- streams, replayed from the tables in micro-batches of one file ----


def _replayed(spark: SparkSession, rows: DataFrame, parts: int = 3, folder: str | None = None, files: int = 1) -> tuple[DataFrame, str]:
    folder = folder or _fresh(spark, "arrivals")
    rows.repartition(parts).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder), folder


@query("SELECT event_type AS type, count(*) AS events FROM events GROUP BY 1")
def stream_activity_counts(spark, d):
    events, _ = _replayed(spark, _t(spark, d, "events").select(F.col("event_type").alias("type")))
    out = _fresh(spark, "counts")
    each = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    jobs.activity_counts(events).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", _fresh(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("type", "events")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def stream_recent_feed(spark, d):
    events, _ = _replayed(spark, _t(spark, d, "events").select("event_id", "ts"))
    state = _fresh(spark, "feed")
    jobs.recent_feed(events, state, _fresh(spark, "ck"), 50, ("ts", "event_id")).awaitTermination()
    return jobs.state_of(spark, state).select("event_id")


@query(f"WITH {LOG} SELECT id, query, latency_ms FROM qlog QUALIFY row_number() OVER (PARTITION BY query ORDER BY ts DESC, id DESC) <= 100")
def stream_latency_ring(spark, d):
    samples, _ = _replayed(spark, log(spark, d).select("query", "ts", "id", "latency_ms"))
    state = _fresh(spark, "ring")
    jobs.latency_ring(samples, state, _fresh(spark, "ck"), ["query"], 100).awaitTermination()
    return jobs.ring_of(spark, state, ["query"], 100).select("id", "query", "latency_ms")


@query(f"WITH {LOG} SELECT id, query FROM qlog WHERE NOT no_log AND id > (SELECT max(id) - 200 FROM qlog WHERE NOT no_log)")
def stream_query_log(spark, d):
    entries, _ = _replayed(spark, log(spark, d).select("id", "query", "no_log"))
    state = _fresh(spark, "log")
    jobs.query_log(entries, state, _fresh(spark, "ck"), 200).awaitTermination()
    return jobs.state_of(spark, state).select("id", "query")


@query("""SELECT run_id, batch, pct FROM (SELECT user_id AS run_id, event_id AS batch, CAST(floor(event_id * 100 / 10000) AS INTEGER) AS pct, lag(CAST(floor(event_id * 100 / 10000) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> pct""")
def stream_progress(spark, d):
    """Progress arrives in order: files of ranges of batches, one after the other."""
    rows = _t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("batch"), F.col("event_id").alias("done"), F.lit(10000).alias("total"))
    folder, out, ck = _fresh(spark, "arrivals"), _fresh(spark, "changes"), _fresh(spark, "ck")
    for rest in range(2):
        arrived = rows.where("batch < 5000" if rest == 0 else "batch >= 5000")
        stream, _ = _replayed(spark, arrived, 1, folder)
        jobs.progress_changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run_id bigint, batch bigint, pct int").parquet(out)


@query(f"WITH {VERSIONS} SELECT project_id, id, content_hash FROM scanned UNION ALL SELECT project_id, id, content_hash FROM stored o WHERE EXISTS (SELECT 1 FROM now n WHERE n.project_id = o.project_id AND n.source_file = o.source_file) AND NOT EXISTS (SELECT 1 FROM scanned s WHERE s.project_id = o.project_id AND s.id = o.id)")
def stream_sync(spark, d):
    """All files arrive, then those that have changed or gone; each batch changes the stored collection by its own chunks."""
    first = candidates(spark, d)
    fields = ["project_id", "source_dir", "source_file", "content", "length"]
    here = first.select(*fields, F.lit(False).alias("deleted"))
    changed = first.where("doc_id % 7 <> 2 and doc_id % 10 = 3").withColumn("content", F.concat("content", F.lit(" changed"))).select(*fields, F.lit(False).alias("deleted"))
    gone = first.where("doc_id % 7 = 2").select(*fields, F.lit(True).alias("deleted"))
    folder, base, ck = _fresh(spark, "arrivals"), _fresh(spark, "collection"), _fresh(spark, "ck")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for rows in (here, changed.unionByName(gone)):
        stream, _ = _replayed(spark, rows, parts, folder, parts)  # each lot is one micro-batch
        jobs.sync_stream(stream, base, ck, lambda f: chunks.chunk_files(f, 1000), rows=200).awaitTermination()
    return collection.read_chunks(spark, base).select("project_id", "id", "content_hash")


# ---- vectors from text, imports ----


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS word FROM documents), b AS (SELECT doc_id, list_sum(list_transform([1, 2, 3, 4], lambda i: (instr('0123456789abcdef', substr(sha256(word), i, 1)) - 1) * CAST(pow(16, 4 - i) AS BIGINT))) % 64 AS cell FROM w),
c AS (SELECT doc_id, cell, count(*) AS n FROM b GROUP BY 1, 2) SELECT doc_id, cell, round(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT), 5) AS weight FROM c""")
def hash_embedder(spark, d):
    v = vectors.hash_embedding(_t(spark, d, "documents"), "doc_id", "text")
    return v.select("doc_id", F.posexplode("embedding").alias("cell", "weight")).where("weight > 0").withColumn("weight", F.round("weight", 5))


@query("SELECT 'm' || (vec_id % 2) AS embed_model, len(embedding) AS dim, count(*) AS points FROM embeddings GROUP BY ALL")
def dim_check(spark, d):
    return embed.dim_check(_t(spark, d, "embeddings").select(F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("embed_model"), "embedding"))


IMPORTED = "SELECT {key} AS id, text AS content, lang, NULL AS n FROM documents"


def _page(spark: SparkSession, d: str, page: Column, size: int = 100) -> DataFrame:
    """Documents as pages of another store's export, by source, language and ranges of ids.

    A page's rows are in order, so that it is the same text however often it is made."""
    docs = _t(spark, d, "documents").groupBy("source", "lang", F.floor(F.col("doc_id") / size)).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "lang", "n_chars"))).alias("r"))
    return docs.select(F.to_json(page).alias("page"))


def _shown(docs: DataFrame) -> DataFrame:
    return docs.select("id", "content", F.col("meta")["lang"].alias("lang"), F.col("meta")["n"].alias("n"))


@query(IMPORTED.format(key="'d' || doc_id"))
def import_qdrant_pages(spark, d):
    r = F.transform("r", lambda x: F.struct(x["doc_id"].alias("id"), F.struct(x["text"].alias("content"), x["lang"].alias("lang"), x["n_chars"].alias("n"), F.concat(F.lit("d"), x["doc_id"].cast("string")).alias("doc_id")).alias("payload")))
    return _shown(imports.import_qdrant(_page(spark, d, F.struct(F.struct(r.alias("points")).alias("result")))))


@query(IMPORTED.format(key="CAST(doc_id AS VARCHAR)"))
def import_pinecone_pages(spark, d):
    r = F.map_from_entries(F.transform("r", lambda x: F.struct(x["doc_id"].cast("string"), F.struct(x["doc_id"].cast("string").alias("id"), F.struct(x["text"].alias("content"), x["lang"].alias("lang"), x["n_chars"].alias("n")).alias("metadata")))))
    return _shown(imports.import_pinecone(_page(spark, d, F.struct(r.alias("vectors")))))


@query(IMPORTED.format(key="'w' || doc_id"))
def import_weaviate_pages(spark, d):
    r = F.transform("r", lambda x: F.struct(x["text"].alias("body"), x["lang"].alias("lang"), x["n_chars"].alias("n"), F.struct(F.concat(F.lit("w"), x["doc_id"].cast("string")).alias("id")).alias("_additional")))
    return _shown(imports.import_weaviate(_page(spark, d, F.struct(F.struct(F.struct(r.alias("Doc")).alias("Get")).alias("data"))), text_field="body"))


@query(IMPORTED.format(key="CAST(doc_id AS VARCHAR)"))
def import_arriving_pages(spark, d):
    """Pages as files that arrive in two lots; the second run takes only the files that are new."""
    r = F.map_from_entries(F.transform("r", lambda x: F.struct(x["doc_id"].cast("string"), F.struct(x["doc_id"].cast("string").alias("id"), F.struct(x["text"].alias("content"), x["lang"].alias("lang"), x["n_chars"].alias("n")).alias("metadata")))))
    made, folder, out, ck = _page(spark, d, F.struct(r.alias("vectors")), 1000), _fresh(spark, "pages"), _fresh(spark, "imported"), _fresh(spark, "ck")
    odd = F.pmod(F.xxhash64("page"), F.lit(2)) == 1
    for rows in (made.where(odd), made.where(~odd)):
        # a file for each page
        rows.select(F.sha2("page", 256).alias("name"), "page").write.partitionBy("name").mode("append").text(folder)
        imports.import_arriving(spark, "pinecone", folder, out, ck, 1000).awaitTermination()
    return _shown(spark.read.parquet(out))


@query(IMPORTED.format(key="CAST(doc_id AS VARCHAR)"))
def import_chroma_pages(spark, d):
    ids = F.array(F.transform("r", lambda x: x["doc_id"].cast("string")))
    documents = F.array(F.transform("r", lambda x: F.when(x["doc_id"] % 2 == 0, x["text"]).otherwise("")))
    meta = F.array(F.transform("r", lambda x: F.struct(x["lang"].alias("lang"), x["n_chars"].alias("n"), x["text"].alias("content"))))
    return _shown(imports.import_chroma(_page(spark, d, F.struct(ids.alias("ids"), documents.alias("documents"), meta.alias("metadatas")))))
