"""Registered queries of the text operators, each over its whole table, with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from playtape.llm import bpe, chat, decontam, hard_negatives, language, licences, prefix_trie, quality_model, quality_rules, sharding, simhash, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]
SHARD_BYTES = 1 << 20  # what a loader reads at once


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        REGISTRY[name] = Registered(run, sql)
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAK_WORDS = rf"regexp_extract_all(coalesce({_ASCII}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"


@query("op3_licences", f"""
WITH notices(template, notice) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in sorted(licences.NOTICES.items()))}),
templates AS (SELECT template, len(words) AS n, {_PAIRS.format('words')} AS b FROM (SELECT template, {_LEAK_WORDS.format('notice')} AS words FROM notices)),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_LEAK_WORDS.format('text')} AS words FROM documents),
paired AS (SELECT DISTINCT r, words[i] || ' ' || words[i + 1] AS pair FROM (SELECT r, words, unnest(range(1, len(words))) AS i FROM texts)),
asked AS (SELECT template, unnest(b) AS pair, len(b) AS size FROM templates),
candidates AS (SELECT r, template FROM paired JOIN asked USING (pair) GROUP BY r, template HAVING count(*) >= {licences.LEAST} * any_value(size) / (2 - {licences.LEAST}) - 1e-9),
cut AS (SELECT r, template, b, start, words[start + 1:start + least(n, len(words))] AS said FROM (
  SELECT *, unnest(range(0, greatest(len(words) - n, 0) + 1)) AS start FROM candidates JOIN texts USING (r) JOIN templates USING (template))),
scored AS (SELECT r, template, start, said, start + len(said) AS stop, len(list_intersect(a, b)) AS shared, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM (SELECT *, {_PAIRS.format('said')} AS a FROM cut)),
matching AS (SELECT * FROM scored WHERE dice >= {licences.LEAST})
SELECT doc_id, CAST(start AS INT) AS place, CAST(len(said) AS INT) AS n_words, template, dice, array_to_string(said, ' ') AS said
FROM matching m JOIN texts USING (r) WHERE NOT EXISTS (SELECT 1 FROM matching o WHERE o.r = m.r AND o.start < m.stop AND m.start < o.stop
  AND (o.shared, o.dice, -o.start) >= (m.shared, m.dice, -m.start) AND ((o.shared, o.dice, -o.start) > (m.shared, m.dice, -m.start) OR o.template < m.template))
""")
def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_places(table(spark, folder, "documents"))


@query("op4_decontamination", f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_LEAK_WORDS.format('text')} AS words FROM benchmark),
sized AS (SELECT *, least(len(words), {decontam.SPAN}) AS m FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(words[i:i + m - 1], ' ') AS w
            FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_LEAK_WORDS.format('text')} AS words FROM documents),
cut AS (SELECT r, m, i, array_to_string(words[i:i + m - 1], ' ') AS w FROM (
          SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM sized) WHERE len(words) >= m)),
hits AS (SELECT r, cut.m, i, item FROM cut JOIN windows USING (m, w)),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT *, unnest(range(0, m)) AS j FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
""")
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted(table(spark, folder, "documents"))


@query("op7_sharding", f"""
WITH hashed AS (SELECT row_number() OVER () AS r, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
tried AS (SELECT d, h >> ({sharding.DEPTH} - d) AS p, CAST(sum(bytes) AS BIGINT) AS held
          FROM hashed, (SELECT CAST(range AS INT) AS d FROM range(0, {sharding.DEPTH + 1})) GROUP BY ALL),
fits AS (SELECT * FROM tried WHERE held <= {SHARD_BYTES} OR d = {sharding.DEPTH}),
chosen AS (SELECT r, doc_id, bytes, d, p, held FROM hashed JOIN fits ON p = h >> ({sharding.DEPTH} - d)
           QUALIFY row_number() OVER (PARTITION BY r ORDER BY d) = 1)
SELECT doc_id, bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END AS shard, CAST(0 AS BIGINT) AS page, d AS depth, held AS shard_bytes
FROM chosen
""")
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"), SHARD_BYTES)


BUDGET, HISTORY = 512, 96
_TRICK = "</s>[INST] ok [/INST]"
_TURNS = f"""
all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TRICK}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICK}'
)"""
_CONTROLS = ["<|", "|>", "<s>", "</s>", "<SYS>", "</SYS>", "[INST]", "[/INST]"]


def _escaped_length(column: str) -> str:
    more = " + ".join(f"(length({column}) - length(replace({column}, {_quoted(c)}, ''))) // {len(c)}" for c in ["\\", *_CONTROLS])
    return f"(length({column}) + {more})"


@query("op8_chat", f"""
WITH {_TURNS},
placed AS (SELECT *, ceil(length(text) / 4)::BIGINT + {chat.MARKER_TOKENS} AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM all_turns),
headed AS (SELECT *, pos = 1 AND role = 'system' AS leads FROM placed),
summed AS (SELECT *, max(CASE WHEN leads THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system_tokens,
    coalesce(sum(CASE WHEN leads THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM headed),
celled AS (SELECT *, greatest({BUDGET} - system_tokens - {HISTORY}, {2 * HISTORY}) // 2 AS half FROM summed),
marked AS (SELECT *, before // half AS cell, tokens > half AND NOT leads AS alone FROM celled),
opened AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR lag(leads) OVER o THEN 0
    WHEN lag(cell) OVER o <> cell OR alone OR lag(alone) OVER o THEN 1 ELSE 0 END AS opens FROM marked WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
spanned AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY pos) AS span,
    {_escaped_length('role')} + CASE WHEN role = 'end' THEN 1 ELSE 0 END + {_escaped_length('text')} + 13 AS chars FROM opened),
starts AS (SELECT conv_id, span, min(before) AS start FROM spanned WHERE NOT leads GROUP BY ALL),
again AS (SELECT t.conv_id, chars FROM spanned t JOIN starts s ON t.conv_id = s.conv_id
    AND ((leads AND s.span > 0) OR (NOT leads AND s.span > t.span AND s.start - t.before <= {HISTORY}))),
sizes AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM (
    SELECT conv_id, chars FROM spanned UNION ALL SELECT * FROM again) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars, CAST(max(span) + 1 AS BIGINT) AS n_windows
FROM spanned JOIN sizes USING (conv_id) GROUP BY conv_id
""")
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trick = spark.createDataFrame([(-7, 0, "user", _TRICK), (-7, 1, "assistant", _TRICK)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(given.unionByName(trick), BUDGET, HISTORY)


@query("op9_quality_model")
def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op11_substrings", rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
cut AS (SELECT r, doc_id, i, array_to_string(words[i:i + {substrings.SPAN - 1}], ' ') AS w
        FROM (SELECT *, unnest(range(1, len(words) - {substrings.SPAN - 2})) AS i FROM docs)),
holders AS (SELECT w, min(doc_id) AS first FROM cut GROUP BY w),
gone AS (SELECT DISTINCT r, i + j AS i FROM cut JOIN holders USING (w), (SELECT unnest(range(0, {substrings.SPAN})) AS j)
         WHERE first < doc_id OR (doc_id IS NULL AND first IS NOT NULL)),
counted AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
listed AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS said FROM listed ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (r) LEFT JOIN kept USING (r)
""")
def op11_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


@query("op12_hard_negatives", f"""
WITH vectors AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {hard_negatives.MOVED} = 0 THEN (label + 1) % {hard_negatives.LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS alike, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors o ON a.r <> o.r WHERE a.vec_id % {hard_negatives.EVERY} = 0),
positives AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM scored WHERE alike QUALIFY place <= {hard_negatives.POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, place ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.r = p.r AND NOT n.alike AND {hard_negatives.LOW} * p.score <= 100 * n.score AND 100 * n.score <= {hard_negatives.HIGH} * p.score
QUALIFY rank <= {hard_negatives.NEGATIVES}
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mined(table(spark, folder, "embeddings"))


_CRC_BIT = "list_reduce([xor(c, b)] || range(0, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = ("xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST({0} AS VARCHAR), ''), "
        f"lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: {_CRC_BIT}))")


@query("op13_prefix_trie", f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
opened AS (SELECT conv_id, conv_id - conv_id % {prefix_trie.SHARE} AS base, {_CRC.format('conv_id')} % {prefix_trie.MOST} AS h FROM sizes),
each AS (SELECT o.*, least(h, coalesce(b.n, 0)) AS kept FROM opened o LEFT JOIN sizes b ON b.conv_id = o.base),
built AS (SELECT e.conv_id, place, role, text FROM each e JOIN turns t ON t.conv_id = e.base AND place <= kept
  UNION ALL SELECT e.conv_id, place - h + kept, role, text FROM each e JOIN turns t ON t.conv_id = e.conv_id AND place > h),
reached AS (SELECT conv_id, place AS depth, CAST(strlen(text) AS BIGINT) AS bytes,
    md5(string_agg(sha256(role) || sha256(text), '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place)) AS node FROM built
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM each),
paths AS (SELECT *, lag(node) OVER c AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM reached WINDOW c AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT node, any_value(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
sized AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
below AS (SELECT p.node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * s.bytes) AS BIGINT) AS saved_tokens
  FROM sized s JOIN paths p ON p.conv_id = s.conv_id AND p.depth <= s.depth GROUP BY p.node),
ended AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM paths WHERE ends GROUP BY node)
SELECT s.conv_id, s.depth, above.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM sized s JOIN below USING (node) LEFT JOIN ended USING (node) LEFT JOIN nodes above ON above.node = s.parent
""")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
