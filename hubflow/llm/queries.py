"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm import chat, embeddings, exact, extraction, langid, lexical, licences, mixing, packing, simhash, tokens, toxicity, trie
from hubflow.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("pattern_size").alias("source_size"), F.round("target", 3).alias("target"), "taken", "copies", F.col("members")[0].alias("source"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.END}{chat.START}assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("tree"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = rows.unionByName(extra)
    scored = lambda df: chat.chain(df, "turn").withColumn("score", F.lit(0.0))
    # a chain's places are the numbers from 0, whatever breaks ties, so its skeleton needs no texts
    made = chat.format_branches(scored(rows), skeleton=scored(rows.select("tree", "turn"))).withColumn("turns", chat.read_turns(F.col("formatted")))
    under = F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "")
    return made.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs, tokenizer_path("piece_bpe_32k.model")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_simhash, op4_packing, op5_licences, op6_toxicity, op7_chat, op8_embeddings, op9_html, op10_exact, op11_trie, op12_language, op13_search, pipeline)}


WHITE_SQL = r"[\x20\x09-\x0D]"

OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
r AS (SELECT *, 3.0 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CAST(CASE WHEN k >= coalesce((SELECT min(k) FROM l WHERE cap > level * weight), 1e9) THEN weight * (SELECT level FROM l x WHERE x.k = (SELECT min(k) FROM l WHERE cap > level * weight)) ELSE cap END AS DOUBLE) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round_even(target, 0) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
o AS (SELECT d.*, q.source_size, q.target, q.whole, CAST(round_even(q.target, 0) AS BIGINT) - q.whole * q.source_size AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 3) AS target,
  CAST((whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS BIGINT) AS copies, source FROM o
"""



def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licences.PHRASES.items())}) x(phrase, label)),
e AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
n AS (SELECT *, lead(word) OVER v AS word2, lead(word, 2) OVER v AS word3 FROM e WINDOW v AS (PARTITION BY r ORDER BY pos)),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(label) AS labels FROM n JOIN p ON p[1] = word AND p[2] = word2 AND (len(p) = 2 OR p[3] = word3) GROUP BY r),
t AS (SELECT t, label, regexp_extract_all({_LOW.format("body")}, {_WORDS}) AS w FROM (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(licences.TEMPLATES))}) x(t, label, body)),
u AS (SELECT DISTINCT t, label, len(w) AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM t),
k AS (SELECT DISTINCT label, pair FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a in licences.MARKS for b in licences.mark_pairs(a, licences.MARKS))}) x(label, pair)),
l AS (SELECT t, u.label, any_value(floor(n / {licences.CONTAINMENT} + 1e-9)) AS length, count(*) AS size, count(k.pair) AS marks FROM u LEFT JOIN k ON k.label = u.label AND k.pair = u.pair GROUP BY t, u.label),
h AS (SELECT n.r, u.t, l.label, l.length, l.size, l.marks, u.pair, n.pos, EXISTS (SELECT 1 FROM k WHERE k.label = u.label AND k.pair = u.pair) AS mark FROM n JOIN u ON u.pair = n.word || ' ' || n.word2 JOIN l ON l.t = u.t),
c AS (SELECT a.r, a.t, a.label, a.size, a.marks, count(DISTINCT o.pair) AS shared, count(DISTINCT o.pair) FILTER (o.mark) AS marked FROM h a JOIN h o ON o.r = a.r AND o.t = a.t AND o.pos >= a.pos AND o.pos < a.pos + a.length - 1 GROUP BY a.r, a.t, a.label, a.size, a.marks, a.pos),
m AS (SELECT r, list(label) AS labels, max(shared / size) AS most FROM c WHERE marked = marks AND shared >= greatest(1, ceil(size * {licences.CONTAINMENT} - 1e-9)) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(most, 0) END AS DOUBLE) AS score FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN m ON m.r = d.r
"""

OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP8_SQL = r"""
WITH RECURSIVE g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM g WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT g.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, g.vec_id = c.component_id AS kept
FROM g JOIN c ON g.vec_id = c.a LEFT JOIN n ON g.vec_id = n.a
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256, CAST(n AS BIGINT) AS n_points FROM g
"""

#: CRC-32 in SQL: a table of 256 remainders, then a fold over the digits. A turn is the hash of its role and text.
OP11_SQL = """
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i)) AS tab),
t AS (SELECT conv_id AS c, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) || ':' || length(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(b ORDER BY turn NULLS FIRST, b) AS s FROM t GROUP BY c),
h AS (SELECT c, s, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, tab[CAST(xor(a & 255, x) + 1 AS INTEGER)]), 4294967295), 4294967295) % 6 AS h FROM o, k),
r AS (SELECT h.c, list_concat(coalesce(b.s[1:h], []), h.s[h + 1:]) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
n AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
g AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM n GROUP BY d, p),
x AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * CAST(split_part(p[d], ':', 2) AS BIGINT) ELSE 0 END AS own FROM g LEFT JOIN x USING (p)),
u AS (SELECT p[1:e] AS p, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, v.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (p) LEFT JOIN g v ON w.d > 0 AND v.d = w.d - 1 AND v.p = w.p[1:w.d - 1]
"""

_TERMS = f"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)) AS impact FROM p, s),
c AS (SELECT i, item_id, r, doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN m USING (term) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS k FROM c WHERE score > 0) WHERE k <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op5_licences": OP5_SQL, "op7_chat": OP7_SQL, "op8_embeddings": OP8_SQL, "op10_exact": OP10_SQL, "op11_trie": OP11_SQL, "op13_search": OP13_SQL}
