"""The corpus queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulant.llm.best_fit import best_fit_pack
from tabulant.llm.centroids import cluster_report
from tabulant.llm.common import table
from tabulant.llm.conversation_repair import damaged, repair_report
from tabulant.llm.exact_dedup import exact_dedup
from tabulant.llm.jaccard_join import jaccard_components
from tabulant.llm.licenses import license_scan, license_sql
from tabulant.llm.lm_scoring import score_texts
from tabulant.llm.mixing import mixing_schedule
from tabulant.llm.packing import pack_documents
from tabulant.llm.quality_rules import quality_rules
from tabulant.llm.secrets import secret_scan
from tabulant.llm.url_filters import LISTED, PATTERNS, url_filter
from tabulant.llm.warc import warc_round_trip


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc_round_trip(table(spark, sf_dir, "pages"), spark).select(*columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, p=90, q=100)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_schedule(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1, dims=64, scale=64.0)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")), gone_col="gone")


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_url_filters": op9_url_filters,
    "op10_mixing": op10_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_conversation_repair": op13_conversation_repair,
}

_OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS k, sha1(html) AS h FROM p),
w AS (SELECT k, max(page_id) AS winner FROM d GROUP BY k)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 8), lambda g:
    list_reduce(list_transform([15, 10, 5, 0], lambda b:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (g * 5 + 1)::INT, 5))::INT >> b::INT) & 31) + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM d JOIN w USING (k)
"""

_OP8_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n_shingles + nb.n_shingles - shared)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT n.doc_id, n_shingles, min(reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n_shingles
"""

_OP3_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def _op9_sql() -> str:
    listed = ", ".join(f"('{r.name}', '{r.verdict}', '{r.pattern}')" for r in LISTED)
    patterns = ", ".join(f"('{r.name}', '{r.pattern}')" for r in PATTERNS)
    return rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
u AS (SELECT DISTINCT host || path AS target FROM p),
listed(name, verdict, pattern) AS (VALUES {listed}),
patterns(name, pattern) AS (VALUES {patterns}),
l AS (SELECT target, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM u JOIN listed ON regexp_matches(target, pattern) GROUP BY target),
b AS (SELECT target, max(name) AS pattern_rule FROM u JOIN patterns ON regexp_matches(target, pattern) GROUP BY target)
SELECT page_id, host, path, l.rule, CASE WHEN l.rule IS NOT NULL THEN l.verdict WHEN b.pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN l.rule IS NULL THEN b.pattern_rule END AS pattern_rule
FROM p LEFT JOIN l ON l.target = host || path LEFT JOIN b ON b.target = host || path
"""


def _op11_sql(k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64) -> str:
    distance = "list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""r AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM r ORDER BY h, v LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(n, d::HUGEINT * {k} + n) AS n, min(d) AS d
  FROM (SELECT r.id, r.vec_id, r.v, c.n, {distance} AS d FROM r CROSS JOIN c{i} c) GROUP BY id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  WITH s AS (SELECT n, place, sum(x) AS total, count(*)::HUGEINT AS m FROM (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY n, place)
  SELECT n, list(((total - ((total % m) + m) % m) // m)::BIGINT ORDER BY place) AS v FROM s GROUP BY n
  UNION ALL SELECT n, v FROM c{i} WHERE n NOT IN (SELECT n FROM s))""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, a.n::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.n = a.n
"""


def _op13_sql() -> str:
    """CRC-32 bit by bit, the Viterbi steps as a fold over a conversation's rows, and the edits replayed on them."""
    never = 1_000_000_000

    def more(x: str, letters: str, cost: str) -> str:
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letters}'}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    keep = lambda x, initial: more(x, "K", f"CASE WHEN r.go OR r.i <> '{initial}' THEN {never} ELSE r.cut END")
    rerole = lambda x: more(x, "R", f"CASE WHEN r.go THEN {never} ELSE r.cut + 3 END")
    user = least("s.n2", more("s.n0", "I", "3"), more("s.n1", "I", "3"), more("s.n3", "I", "3"))
    assistant = least("s.n3", more("s.n2", "I", "3"), more("s.n0", "II", "6"), more("s.n1", "II", "6"))
    after_turn = [f(x) for x in ("s.n0", "s.n1", "p.n3") for f in (lambda x: keep(x, "u"), rerole)]
    step = f"""list_transform([{{'n2': {user}, 'n3': {assistant}}}], lambda p: {{'i': r.i, 'go': r.go, 'cut': r.cut, 'n0': {more("s.n0", "D", "4")},
      'n1': {least(more("s.n1", "D", "4"), keep("s.n0", "s"))}, 'n2': {least(more("p.n2", "D", "4"), *after_turn)}, 'n3': {least(more("p.n3", "D", "4"), keep("p.n2", "a"), rerole("p.n2"))}}})[1]"""
    start, none = "{'c': 0::BIGINT, 'a': ''}", f"{{'c': {never}::BIGINT, 'a': ''}}"
    states = f"'n0': {start}, 'n1': {none}, 'n2': {none}, 'n3': {none}"
    end = least("fin.n0", more("fin.n1", "II", "6"), more("fin.n2", "I", "3"), "fin.n3")
    at = "rows[s.r + 1]"
    replay = f"""{{'l': x.l, 'r': s.r + CASE WHEN x.l = 'I' THEN 0 ELSE 1 END, 'st': CASE WHEN x.l = 'D' THEN s.st WHEN x.l = 'K' AND s.st = 0 AND {at}.i = 's' THEN 1 WHEN s.st = 2 THEN 3 ELSE 2 END,
      'o': CASE WHEN x.l = 'D' THEN s.o ELSE list_append(s.o, CASE WHEN x.l = 'K' THEN {at}.role WHEN s.st = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN x.l = 'I' THEN '' ELSE {at}.text END) END}}"""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {crc} % 20 AS hit FROM c),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h CROSS JOIN (VALUES (0), (1)) v(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault FROM d),
g AS (SELECT conv_id, list({{'role': role, 'text': text, 'fault': fault, 'i': i}} ORDER BY turn NULLS FIRST, role, text, fault = 'duplicate') AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM f GROUP BY conv_id),
v AS (SELECT *, list_reduce(list_prepend({{'i': '', 'go': false, 'cut': 0::BIGINT, {states}}},
        list_transform(rows, lambda r: {{'i': r.i, 'go': r.fault IN ('blank', 'duplicate'), 'cut': CASE WHEN r.fault = 'truncated' THEN 3::BIGINT ELSE 0::BIGINT END, {states}}})),
      lambda s, r: {step}) AS fin FROM g),
e AS (SELECT *, {end} AS best FROM v),
o AS (SELECT *, list_reduce(list_prepend({{'l': '', 'r': 0::BIGINT, 'st': 0, 'o': []::VARCHAR[]}}, list_transform(range(1, length(best.a) + 1), lambda k: {{'l': substr(best.a, k, 1), 'r': 0::BIGINT, 'st': 0, 'o': []::VARCHAR[]}})),
      lambda s, x: {replay}).o AS said, len(list_filter(range(1, len(rows)), lambda k: (rows[k].i || rows[k + 1].i) NOT IN ('su', 'ua', 'au'))) AS illegal FROM e)
SELECT t.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""


ORACLE_SQL = {
    "op1_license_scans": license_sql(),
    "op2_warc": _OP2_SQL,
    "op3_exact_dedup": _OP3_SQL,
    "op8_ngram_jaccard_join": _OP8_SQL,
    "op9_url_filters": _op9_sql(),
    "op11_centroid_clustering": _op11_sql(),
    "op13_conversation_repair": _op13_sql(),
}
