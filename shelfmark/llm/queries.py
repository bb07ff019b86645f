"""The operators of this subpackage as queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.centroid_clusters import cluster
from shelfmark.llm.contamination import contamination
from shelfmark.llm.conversation_repair import damage, repair
from shelfmark.llm.encoding import tokenizer_path
from shelfmark.llm.exact_search import top_k
from shelfmark.llm.language_model import score_texts
from shelfmark.llm.metric_join import range_join
from shelfmark.llm.near_duplicates import near_duplicates
from shelfmark.llm.packing import pack
from shelfmark.llm.quality import fit_quality, fold, score_quality
from shelfmark.llm.sharding import shard
from shelfmark.llm.token_counts import token_counts
from shelfmark.llm.token_files import read_token_files, write_token_files
from shelfmark.llm.url_filter import Rule, judge_urls
from shelfmark.session import ship_package, work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(ship_package(spark), folder)

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = work_dir(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), files, end_id=0)
    return read_token_files(spark, files, with_ids=False)


_RANGE_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id"""


@query(_RANGE_SQL)
def op3_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return range_join(table(spark, folder, "embeddings"))


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(table(spark, folder, "documents"), shards=24)


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _rules_sql() -> str:
    ranked = sorted(RULES, key=lambda rule: -len(rule.name))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in ranked]
    rule = " ".join(f"WHEN {test} THEN '{r.name}'" for test, r in fits)
    verdict = " ".join(f"WHEN {test} THEN '{r.verdict}'" for test, r in fits)
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM split"""


@query(_rules_sql())
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), RULES)


@query()
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query()
def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


@query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2).drop("ids")


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    network = fit_quality(documents, table(spark, folder, "labels"))
    scores = score_quality(documents.select("doc_id", "text"), network)
    return scores.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_WHOLE_NUMBERS = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    nearest = """SELECT vec_id, v, c, d FROM (
      SELECT kept.vec_id, kept.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - m.v[i]) * (kept.v[i] - m.v[i]))) AS d,
             row_number() OVER (PARTITION BY kept.vec_id ORDER BY d, m.c) AS n FROM kept, m{0} m) WHERE n = 1"""
    steps = ""
    for r in range(rounds):
        steps += f""", a{r} AS MATERIALIZED ({nearest.format(r)}),
  m{r + 1} AS MATERIALIZED (
    SELECT m.c, coalesce(s.v, m.v) AS v FROM m{r} m LEFT JOIN (
      SELECT c, list(floor(x / n)::BIGINT ORDER BY i) AS v FROM (
        SELECT c, i, sum(x)::DOUBLE AS x, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i)
      GROUP BY c) s ON s.c = m.c)"""
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND {_WHOLE_NUMBERS}),
  m0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k})){steps},
  found AS MATERIALIZED ({nearest.format(rounds)}),
  per AS (SELECT c, sum(d)::BIGINT AS s FROM found GROUP BY c)
SELECT vec_id, found.c::INTEGER AS cluster, d::BIGINT AS distance, s AS cluster_inertia, (SELECT sum(d)::BIGINT FROM found) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM found JOIN per ON per.c = found.c JOIN m{rounds} m ON m.c = found.c"""


@query(_clusters_sql())
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings"))


_SEARCH_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND {_WHOLE_NUMBERS}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 10"""


@query(_SEARCH_SQL)
def op12_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def _repair_sql() -> str:
    """Rests of conversations from the last row backwards: ``cost audit|repaired`` for each state of the grammar as one text."""
    after, put = {"_": "u", "s": "u", "u": "a", "a": "u"}, {"_": "user", "s": "user", "u": "assistant", "a": "user"}

    def more(rest: str, cost: str, edit: str, line: str = "''") -> str:
        audit, text = f"split_part(substr({rest}, 9), '|', 1)", f"substr({rest}, 9 + strpos(substr({rest}, 9), '|'))"
        return f"lpad((substr({rest}, 1, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || '{edit}' || {audit} || '|' || {line} || {text}"

    inserted = {q: f"'{put[q]}:' || chr(10)" for q in put}
    raw = []
    for q in put:
        line = f"'{put[q]}:' || text || chr(10)"
        system = f"WHEN 's' THEN {more('r.s', 'late', 'K', 'own')}" if q == "_" else ""
        kept = f"CASE left(role, 1) {system} WHEN '{after[q]}' THEN {more('r.' + after[q], 'late', 'K', 'own')} END"
        rerole = more("r." + after[q], "3 + late", "R", line)
        allowed = "CASE WHEN fault NOT IN ('b', 'd') THEN"
        raw.append(f"least({more('r.' + q, '4', 'D')}, {allowed} {rerole} END, {allowed} {kept} END) AS {q}")
    u = f"least(u, {more('a', '3', 'I', inserted['u'])})"
    closed = [f"least(_, {more('v', '3', 'I', inserted['_'])}) AS _", f"least(s, {more('v', '3', 'I', inserted['s'])}) AS s", "v AS u",
              f"least(a, {more('u', '3', 'I', inserted['a'])}) AS a"]
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT)), lambda sum, byte:
      list_reduce(list_prepend(xor(sum, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) FROM kinds)
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM (SELECT *, rtrim(text, {space}) AS solid FROM placed)
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), rest AS (
  SELECT conv_id, n AS i, '00000000|' AS _, '00000006II|user:' || chr(10) || 'assistant:' || chr(10) AS s,
         '00000003I|assistant:' || chr(10) AS u, '00000000|' AS a FROM counted
  UNION ALL
  SELECT conv_id, i, {', '.join(closed)} FROM (SELECT *, {u} AS v FROM (
    SELECT conv_id, i - 1 AS i, {', '.join(raw)} FROM (
      SELECT f.*, struct_pack(_ := r._, s := r.s, u := r.u, a := r.a) AS r, CASE fault WHEN 't' THEN 3 ELSE 0 END AS late, role || ':' || text || chr(10) AS own
      FROM rest r JOIN faulty f ON f.conv_id = r.conv_id AND f.i = r.i)))
), found AS (SELECT conv_id, substr(_, 1, 8)::BIGINT AS cost, split_part(substr(_, 9), '|', 1) AS audit, substr(_, 9 + strpos(substr(_, 9), '|')) AS text FROM rest WHERE i = 0)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(text, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counted USING (conv_id) LEFT JOIN found USING (conv_id)"""


@query(_repair_sql())
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damage(table(spark, folder, "conversations")))
