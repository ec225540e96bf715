"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table.

`queries()` and `oracle_sql()` are what the entry module takes. The queries are thin: contracts that ask for digests are
met here, from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, chat, html_wrappers, line_dedup, minmax_dedup, mixing, packing, prefix_trie, quality, token_counts, topk, toxicity, url_rules
from .common import table

#: The rules that op10 judges by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Documents of a higher score are predicted toxic.
TOXIC_FROM = 0.3


#: Shares of tokens that op5 rakes to; sources and topics, and languages not named, are tempered or keep their shares.
MIX_TARGETS = {"lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5, scale=256)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.group(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {m: spark.createDataFrame(list(t.items()), "value string, share double") for m, t in MIX_TARGETS.items()}
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), targets, carried=["doc_id", "source", "lang"])
    return mixed.select(
        "doc_id",
        "source",
        "lang",
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_probability").alias("probability"),
        F.col("_drawn").alias("drawn"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.segments(turns), in_order=True)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 4
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), conv - conv % 20, head, most=3)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=16, rounds=3, scale=64, length=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_exact_topk,
        op3_html_text,
        op4_minmax_dedup,
        op5_mixing,
        op6_chat_format,
        op7_quality_rules,
        op8_hilbert_packing,
        op9_line_dedup,
        op10_url_filter,
        op11_prefix_trie,
        op12_token_counts,
        op13_centroids,
    )
}

_OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""

# valid: a system turn or none, then user and assistant in turn
_OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, length('### ' || role || ': ') + length(' </turn>' || chr(10))
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS chars FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role || ';', '' ORDER BY turn, role, text), '(system;)?(user;assistant;)*(user;)?') AS valid
FROM f GROUP BY conv_id
"""

_GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS s
  FROM documents
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n
  FROM (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS five FROM d)
), c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY r
), k AS (
  SELECT r, length(x) AS chars, regexp_matches(rtrim(x, {_GAPS}), {_quoted(quality.CLOSED)})
    AND NOT (regexp_matches(x, {_quoted(quality.NAVIGATION)}) OR regexp_matches(x, {_quoted(quality.BOILERPLATE)}))
    AND 100 * (length(x) - length(regexp_replace(x, '[{quality.SYMBOLS}]', '', 'g'))) <= {quality.MAX_SYMBOL_PERCENT} * length(x)
    AND 100 * (length(x) - length(regexp_replace(x, '{quality.BARS}', '', 'g'))) <= {quality.MAX_BAR_PERCENT} * length(x) AS stays
  FROM (SELECT r, unnest(s) AS x FROM d)
), l AS (SELECT r, sum(chars) AS line_chars, coalesce(sum(chars) FILTER (stays), 0) AS kept_chars FROM k GROUP BY r
), b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[{quality.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    (len(s) - len(list_distinct(s)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
), f AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * kept_chars >= {quality.MIN_KEPT_PERCENT} * line_chars AS kept
FROM f
"""

_OP4_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 80 * (m.n + o.n - c)
), r AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT root, b FROM r JOIN e ON a = node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS c FROM r GROUP BY node) c ON c.node = d.doc_id
"""

# levenshtein() there counts bytes, so letters beyond ASCII become control characters first; of three thirds one is equal
_OP9_SQL = rf"""
WITH o AS (
  SELECT doc_id, i::BIGINT AS line_no, s[i + 1] AS line
  FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT string_agg(x, '' ORDER BY x) AS x FROM (SELECT DISTINCT unnest(string_split(regexp_replace(line, '[\x00-\x7F]', '', 'g'), '')) AS x FROM o) WHERE x <> ''
), c AS (
  SELECT line, translate(line, w.x, (SELECT string_agg(chr(i::INTEGER), '' ORDER BY i) FROM range(1, 128) r(i) WHERE i < 9 OR i BETWEEN 14 AND 31 OR i = 127)) AS t,
    length(line) AS n, f.doc_id AS class_doc, f.line_no AS class_line, row_number() OVER (ORDER BY f.doc_id, f.line_no) AS id
  FROM (SELECT line, min({{'doc_id': doc_id, 'line_no': line_no}}) AS f FROM o GROUP BY line), w
), p AS (
  SELECT s.id AS a, r.id AS b, s.t AS x, r.t AS y, CASE WHEN s.n < {line_dedup.LONG} THEN 1 ELSE 2 END AS k FROM c s JOIN c r ON r.n - s.n IN (0, 1, 2)
  WHERE (r.n > s.n OR s.id < r.id) AND (left(s.t, s.n // 3) = left(r.t, s.n // 3) OR right(s.t, s.n // 3) = right(r.t, s.n // 3) OR contains(r.t, substr(s.t, s.n // 3 + 1, s.n - 2 * (s.n // 3))))
), l AS (SELECT a, b FROM p WHERE abs(length(x) - length(y)) <= k AND levenshtein(x, y) <= k
), t AS (SELECT id, count(*) AS n, min(other) AS first FROM (SELECT a AS id, b AS other FROM l UNION ALL SELECT b, a FROM l) GROUP BY id)
SELECT doc_id, line_no, class_doc, class_line, coalesce(t.n, 0)::BIGINT AS n_links,
  doc_id = class_doc AND line_no = class_line AND (t.first IS NULL OR c.id < t.first) AS kept
FROM o JOIN c USING (line) LEFT JOIN t USING (id)
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_OP10_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}
), f AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""

# crc32 by bits: each byte is mixed in and shifted out eight times
_OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT h.c, t.i, role, text FROM h JOIN t ON t.c = base AND t.i <= h UNION ALL
  SELECT h.c, t.i - h + (SELECT count(*) FROM t b WHERE b.c = base AND b.i <= h), role, text FROM h JOIN t ON t.c = h.c AND t.i > h
), p AS (
  SELECT c, i AS d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY i) AS p,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM r
  UNION ALL SELECT c, 0, '', 0 FROM h
), l AS (SELECT c, max(d) AS n FROM p GROUP BY c
), n AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256 FROM p JOIN l USING (c) GROUP BY p, d
), k AS (SELECT left(p, 64 * (d - 1)) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)
), b AS (
  SELECT u.p, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved FROM m u JOIN m v ON starts_with(v.p, u.p) GROUP BY u.p
)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN b USING (p) LEFT JOIN n o ON m.d > 0 AND o.p = left(m.p, 64 * (m.d - 1))
"""


def _op13_sql(rounds: int) -> str:
    """Each round is the table of centroids after it; the last table's assignment is the result."""
    assign = """
  SELECT r, vec_id, v, first(j ORDER BY d, j) AS j, min(d) AS d FROM (
    SELECT v.r, v.vec_id, v.v, c.j, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN {c} c
  ) GROUP BY ALL"""
    move = """
  SELECT j, list(floor_of ORDER BY i) AS v FROM (
    SELECT j, i, (s - ((s % n) + n) % n) // n AS floor_of FROM (
      SELECT j, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS i FROM {a}) GROUP BY j, i)
  ) GROUP BY j UNION ALL SELECT j, v FROM {c} WHERE j NOT IN (SELECT j FROM {a})"""
    steps = [
        """v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v FROM v WHERE vec_id IS NOT NULL ORDER BY j LIMIT 16)"""
    ]
    for n in range(rounds):
        steps += [f"a{n} AS ({assign.format(c=f'c{n}')})", f"c{n + 1} AS ({move.format(a=f'a{n}', c=f'c{n}')})"]
    last = f"c{rounds}"
    steps.append(f"a AS ({assign.format(c=last)})")
    return (
        "WITH "
        + ", ".join(steps)
        + f""" SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a JOIN {last} c ON c.j = a.j"""
    )


SQL: dict[str, str] = {
    "op2_exact_topk": _OP2_SQL,
    "op4_minmax_dedup": _OP4_SQL,
    "op6_chat_format": _OP6_SQL,
    "op7_quality_rules": _OP7_SQL,
    "op9_line_dedup": _OP9_SQL,
    "op10_url_filter": _OP10_SQL,
    "op11_prefix_trie": _OP11_SQL,
    "op13_centroids": _op13_sql(3),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
