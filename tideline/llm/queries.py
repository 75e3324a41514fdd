"""Queries over the operators of this subpackage, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import chat, codes, contamination, language, minhash, mixing, quality, repair, sharding, tokens, toxicity, urls, warc
from tideline.llm.scratch import materialize, scope


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents, those without a doc_id as one."""
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), null_ids=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed_words(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, read from stored prefix counts."""
    return tokens.prefix_answers(tokens.store_prefix_counts(_table(spark, sf_dir, "documents"), tokenizer()), 1024)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their written windows."""
    turns = chat.with_control_conversation(_table(spark, sf_dir, "conversations"))
    return chat.read_digests(materialize(chat.format_windows(turns, tokenizer()), "windows"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, read back from the archives."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, under the law ``rows``."""
    return sharding.sharded_rows(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base filter, and the verdict of the learned list."""
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine's score of every document."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document over links of four-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.predict_language(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors."""
    return codes.encode(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, edits and repaired digest of every conversation, after the planted damage."""
    return repair.repair_digests(_table(spark, sf_dir, "conversations"))


def chat_turn_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op4_chat_format`` reads back, without the length of its windows, which hangs on token counts and has no SQL."""
    return op4_chat_format(spark, sf_dir).drop("formatted_chars")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the base filter of ``op8_quality_rules``; what the learned list says has no SQL."""
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return materialize(quality.text_statistics(_table(spark, sf_dir, "documents")).select(*wanted, quality.base_failed().alias("base_failed")), "statistics")


def _written(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written, so that its scratch tables can go: one folder is left for as long as somebody may read the result."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scope() as own:
            result = query(spark, sf_dir)
            result = result if hasattr(result, "written_to") else materialize(result, query.__name__)
            own.keep(result)
        return result

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _written(f) for f in (op1_decontamination, op2_mixing, op3_token_counts, op4_chat_format, op5_warc, op6_sharding, op7_url_filter, op8_quality_rules, op9_toxicity, op10_near_duplicates, op11_language, op12_vector_codes, op13_conversation_repair, chat_turn_digests, quality_statistics)
}

_MIXING = r"""
WITH s AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][CAST(rank % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM p
), f AS (
  SELECT *, sum(most) OVER o + most / weight * (sum(weight) OVER () - sum(weight) OVER o) <= budget AS is_full FROM w WINDOW o AS (ORDER BY most / weight, rank)
), l AS (
  SELECT (max(budget) - coalesce(sum(most) FILTER (is_full), 0)) / nullif(sum(weight) FILTER (NOT is_full), 0) AS level FROM f
), t AS (
  SELECT source, source_size, rank, budget, CASE WHEN is_full THEN most ELSE level * weight END AS target FROM f, l
), c AS (
  SELECT s.*, t.rank, t.source_size, t.target, t.budget, sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.key, s.size, s.r) AS reached
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT c.*, pass, CAST(reached + pass * source_size AS DOUBLE) / target AS finish FROM c, (SELECT unnest([0, 1]) AS pass) WHERE size > 0
), m AS (
  SELECT r, size, budget, sum(size) OVER (ORDER BY finish, key, pass, size, r) AS total FROM q
), k AS (
  SELECT r, sum(size) AS taken FROM m WHERE total <= budget GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN k USING (r)
"""

_URLS = r"""
WITH h AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(action, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')
), s AS (
  SELECT action, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM r
), d AS (SELECT DISTINCT host, path FROM h
), b AS (
  SELECT d.host, d.path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM d JOIN s ON (d.host = rule_host OR ends_with(d.host, '.' || rule_host)) AND starts_with(d.path, rule_path) GROUP BY d.host, d.path
)
SELECT page_id, h.host, h.path, b.rule, coalesce(b.action, 'allow') AS verdict FROM h LEFT JOIN b USING (host, path)
"""

_WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), o AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS owner FROM d
), b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(hex, 5 * i // 4 + 1, 2) AS INT) >> CAST(3 - i % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest FROM o
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM b
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i : i + 3], ' ')))) END AS grams FROM w
), c AS MATERIALIZED (SELECT min(doc_id) AS rep, grams, len(grams) AS n FROM s GROUP BY grams
), u AS (SELECT rep, n, unnest(grams) AS gram FROM c
), i AS MATERIALIZED (SELECT rep, n, dense_rank() OVER (ORDER BY gram) AS gram FROM u
), p AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM i a JOIN i b ON a.gram = b.gram AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.rep, b.rep
), l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
), m AS (SELECT node, min(root) AS least FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, CASE WHEN len(s.grams) = 0 THEN s.doc_id ELSE least END AS component_id, CASE WHEN len(s.grams) = 0 THEN TRUE ELSE s.doc_id = least END AS kept
FROM s JOIN c ON c.grams = s.grams JOIN m ON m.node = c.rep
"""

_SHARDING = r"""
WITH RECURSIVE pt AS (
  SELECT s AS shard, md5('point ' || s || ' ' || r) AS digest FROM range(24) a(s), range(64) b(r)
), crc_table AS (
  SELECT list(v ORDER BY i) AS of FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) a(i))
), bytes AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents
), crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(h, lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, of[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM bytes, crc_table
), ring AS (
  SELECT shard, CAST('0x' || digest[1:4] AS INT) AS cell, row_number() OVER (ORDER BY CAST('0x' || digest[1:4] AS INT), digest) - 1 AS arc FROM pt
), k AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest, row_number() OVER (ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS rank FROM documents
), h AS (
  SELECT k.*, coalesce((SELECT min(arc) FROM ring WHERE ring.cell >= CAST('0x' || k.digest[1:4] AS INT)), 1536) AS arc FROM k
), arcs AS (SELECT arc, shard FROM ring UNION ALL SELECT 1536, shard FROM ring WHERE arc = 0
), c AS (
  SELECT a.arc, a.shard, count(doc_id) AS n FROM arcs a LEFT JOIN h ON h.arc = a.arc GROUP BY ALL
), b AS (
  SELECT *, CAST(sum(n) OVER () AS BIGINT) // 24 + CASE WHEN shard < CAST(sum(n) OVER () AS BIGINT) % 24 THEN 1 ELSE 0 END AS bound FROM c
), m AS (
  SELECT *, greatest(0, least(n, bound - sum(n) OVER (PARTITION BY shard ORDER BY arc) + n)) AS home FROM b
), start AS (SELECT list(space ORDER BY shard) AS room FROM (SELECT shard, CAST(max(bound) - sum(home) AS BIGINT) AS space FROM m GROUP BY shard)
), o AS (SELECT arc, CAST(n - home AS BIGINT) AS need, row_number() OVER (ORDER BY arc) AS j FROM m WHERE n > home
), far AS (
  SELECT o.j, o.arc, o.need, r.shard, min((r.arc - o.arc % 1536 + 1535) % 1536 + 1) AS step FROM o, ring r GROUP BY ALL
), q AS (
  SELECT j, arc, need, list(CAST(shard AS INT) ORDER BY step) AS way, list(step ORDER BY step) AS steps FROM far GROUP BY ALL
), walk AS (
  SELECT CAST(0 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS arc, room, CAST([] AS BIGINT[]) AS taken, CAST([] AS INT[]) AS way, CAST([] AS BIGINT[]) AS steps FROM start
  UNION ALL
  SELECT j, arc, list_transform(range(0, 24), lambda s: room[s + 1] - now[list_position(way, s)]), now, way, steps FROM (
    SELECT q.j, q.arc, w.room, q.way, q.steps,
      list_transform(range(1, 25), lambda x: greatest(0, least(w.room[q.way[x] + 1], q.need - coalesce(list_sum(list_transform(q.way[1 : x - 1], lambda y: w.room[y + 1])), 0)))) AS now
    FROM walk w JOIN q ON q.j = w.j + 1)
), pieces AS (
  SELECT arc, 0 AS step, shard, home AS n FROM m WHERE home > 0
  UNION ALL SELECT arc, step, shard, n FROM (SELECT arc, unnest(steps) AS step, unnest(way) AS shard, unnest(taken) AS n FROM walk WHERE j > 0) WHERE n > 0
), ends AS (
  SELECT *, CAST(sum(n) OVER (ORDER BY arc, step) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY shard ORDER BY arc, step) AS BIGINT) AS within FROM pieces
)
SELECT h.doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(rank + within - upto AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM h JOIN ends ON h.rank < upto AND h.rank >= upto - n JOIN crcs USING (doc_id)
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256 FROM c
"""

_STATISTICS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), n AS (
  SELECT *, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM (SELECT r, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) AS gram FROM n WHERE len(words) >= 5)
), c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, range(5) x(k) WHERE times > 1 GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM n LEFT JOIN c USING (r)
"""



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The codebooks round by round: nearest entries by a full comparison of every part with every entry."""
    steps = [
        "k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM k, range({parts}) a(part))",
        f"b0 AS (SELECT part, CAST(n - 1 AS BIGINT) AS entry, x AS e FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n FROM k) JOIN p USING (r) WHERE n <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"n{i} AS MATERIALIZED (SELECT r, part, min((d, entry)) AS best FROM (SELECT r, part, entry, CAST(coalesce(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT) AS d FROM p JOIN b{i} USING (part)) GROUP BY r, part)")
        moved = f"SELECT part, best[2] AS entry, j, CAST(sum(x[j]) AS HUGEINT) AS s, count(*) AS c FROM n{i} JOIN p USING (r, part), range(1, len(x) + 1) a(j) GROUP BY ALL"
        if i < rounds:
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY j) AS e FROM ({moved}) GROUP BY ALL) m USING (part, entry))")
    steps.append(f"c AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM n{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(coalesce(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry), '')) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"


#: A walk over each conversation's turns; for each of four ends (nothing, system, user, assistant) the cheapest edits with what they leave.
_REPAIR = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS of FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) a(i))
), t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..') AS h FROM conversations
), x AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(h, lambda y: CAST('0x' || y AS BIGINT))), lambda c, b: xor(c >> 8, of[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS roll FROM t, crc_table
), d AS (
  SELECT conv_id, turn, CASE WHEN roll = 4 THEN 'user' ELSE role END AS role, CASE roll WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM x, range(2) a(copy) WHERE roll <> 0 AND (copy = 0 OR roll = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d
), f AS (
  SELECT *, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), FALSE) AS illegal,
    CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o
), g AS MATERIALIZED (
  SELECT conv_id, i, role, text, left(role, 1) AS c, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f
), s AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM f GROUP BY conv_id
), w(conv_id, i, state, cost, audit, said) AS (
  SELECT conv_id, 0::BIGINT, state, cost, audit, said FROM s, (VALUES ('', 0, '', ''), ('u', 5, 'I', chr(10) || 'user:'), ('a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) v(state, cost, audit, said)
  UNION ALL
  (WITH e AS (
    SELECT w.conv_id, g.i, w.state, w.cost, w.audit, w.said, g.c, g.role, g.text, g.gone, g.more FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1
  ), one AS (
    SELECT conv_id, i, state, cost + 2 AS cost, audit || 'D' AS audit, said FROM e
    UNION ALL SELECT conv_id, i, c, cost + more, audit || 'K', said || chr(10) || role || ':' || text FROM e WHERE NOT gone AND (c = 's' AND state = '' OR c = 'u' AND state <> 'u' OR c = 'a' AND state = 'u')
    UNION ALL SELECT conv_id, i, CASE state WHEN 'u' THEN 'a' ELSE 'u' END, cost + more + 1, audit || 'R', said || chr(10) || CASE state WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text FROM e WHERE NOT gone
  ), two AS (
    SELECT * FROM one UNION ALL SELECT conv_id, i, CASE state WHEN 'u' THEN 'a' ELSE 'u' END, cost + 5, audit || 'I', said || chr(10) || CASE state WHEN 'u' THEN 'assistant:' ELSE 'user:' END FROM one
    UNION ALL SELECT conv_id, i, 'a', cost + 10, audit || 'II', said || chr(10) || 'user:' || chr(10) || 'assistant:' FROM one WHERE state <> 'u'
  )
  SELECT conv_id, i, state, b.cost, b.audit, b.said FROM (SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'said': said}) AS b FROM two GROUP BY conv_id, i, state))
), r AS (
  SELECT s.conv_id, min({'cost': w.cost, 'audit': w.audit, 'said': w.said}) AS b FROM s JOIN w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n WHERE w.state IN ('', 'a') GROUP BY s.conv_id
), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(r.b.cost, 0) AS BIGINT) AS cost, coalesce(r.b.audit, '') AS audit, sha256(coalesce(substr(r.b.said, 2), '')) AS repaired_sha256
FROM a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLES: dict[str, str] = {"op2_mixing": _MIXING, "op5_warc": _WARC, "op6_sharding": _SHARDING, "op7_url_filter": _URLS, "op10_near_duplicates": _NEAR, "op12_vector_codes": _codes_sql(), "op13_conversation_repair": _REPAIR, "chat_turn_digests": _CHAT, "quality_statistics": _STATISTICS}
