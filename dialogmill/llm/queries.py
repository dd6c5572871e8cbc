"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm import (
    bpe,
    chat_format,
    langid,
    line_dedup,
    lm_score,
    mixing,
    neighbours,
    prefix_trie,
    quality,
    simhash,
    token_files,
    toxicity,
    vector_codes,
)
from dialogmill.llm.common import settled
from dialogmill.session import shared_folder

#: Ids of the vocabulary of word_bpe_49k.json, its special tokens included.
WORD_VOCABULARY = 49_408
SHINGLE_WORDS = 3
MIX_SEED = 0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_folder(spark, "token-files")
    token_files.write_token_files(
        _table(spark, sf_dir, "documents"), folder, lambda texts: token_files.encode_words(texts, vocabulary), WORD_VOCABULARY, end_id=1
    )
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken", "chance")


OP3_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
  FROM documents),
docs AS (
  SELECT doc_id, source, size, coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(text) AS name FROM rows),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(sum(size * least(size, {mixing.FULL_WORDS})) AS DOUBLE) / CAST(greatest(sum(size), 1) AS DOUBLE) / {mixing.FULL_WORDS} AS mean_full,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM docs GROUP BY source),
-- each source as the last one that is filled to twice its size
tried AS (
  SELECT s.source, 2.0 * s.source_size / s.weight AS edge,
         (SELECT 1.5 * sum(source_size) FROM sources)
           - (SELECT coalesce(sum(2 * o.source_size), 0) FROM sources o WHERE 2.0 * o.source_size / o.weight < 2.0 * s.source_size / s.weight) AS remain,
         (SELECT sum(o.weight) FROM sources o WHERE 2.0 * o.source_size / o.weight >= 2.0 * s.source_size / s.weight) AS heavy
  FROM sources s),
chosen AS (SELECT min(edge) AS edge, min_by(CAST(remain AS DOUBLE) / CAST(heavy AS DOUBLE), edge) AS level
           FROM tried WHERE CAST(remain AS DOUBLE) / CAST(heavy AS DOUBLE) <= edge),
plan AS (
  SELECT source, source_size, mean_full,
         CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(2 * source_size AS DOUBLE), level * weight) END AS target
  FROM sources, chosen),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan),
drawn AS (
  SELECT d.*, p.source_size, p.mean_full, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         CASE WHEN p.source_size > 0 THEN (p.target - p.whole * p.source_size) / p.source_size ELSE 0.0 END AS mean,
         (CAST(CAST('0x' || substr(md5('{MIX_SEED}:' || d.name), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / CAST({1 << 52} AS DOUBLE) AS u
  FROM docs d JOIN split p ON d.source IS NOT DISTINCT FROM p.source),
-- within a source the inclusion chance grows with the words
chances AS (
  SELECT *, CASE WHEN mean > 0 THEN least(greatest(
           mean + mean * (1 - mean) * (CAST(least(size, {mixing.FULL_WORDS}) AS DOUBLE) / {mixing.FULL_WORDS} - mean_full),
           CAST({mixing.LEAST_CHANCE!r} AS DOUBLE)), CAST({1 - mixing.LEAST_CHANCE!r} AS DOUBLE)) END AS chance
  FROM drawn),
ranked AS (SELECT *, u / (1 - u) / (chance / (1 - chance)) AS rank FROM chances),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, name RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY source, rank, name) AS own
  FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       whole + CAST(rest > 0 AND upto - own / 2 <= rest AS BIGINT) AS copies,
       CAST(size * (whole + CAST(rest > 0 AND upto - own / 2 <= rest AS BIGINT)) AS BIGINT) AS taken, chance
FROM summed
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.judge(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), SHINGLE_WORDS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), ranks, pattern)
    return decoded.select(
        "doc_id",
        bpe.id_count().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


#: A conversation whose texts look like the template's own control strings.
ODD_CONVERSATION, ODD_TEXT = -7, "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(
        F.lit(ODD_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat_format.digests(chat_format.format_turns(turns))


OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({ODD_CONVERSATION}, 0, 'user', '{ODD_TEXT}'), ({ODD_CONVERSATION}, 1, 'assistant', '{ODD_TEXT}')),
sized AS (
  SELECT *, len(replace(replace(replace(text, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t')) + 8
           + CASE WHEN lag(role) OVER seen IS NOT DISTINCT FROM role THEN 0
                  ELSE 6 + len(replace(replace(replace(replace(role, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t'), ':', '\\c')) END AS chars
  FROM turns WINDOW seen AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
told AS (
  SELECT conv_id, count(*) AS n_turns, CAST(sum(chars) AS BIGINT) AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM told
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = settled(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")), "ordered")
    return prefix_trie.build(prefix_trie.shared_starts(ordered))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest, turn,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ordered AS (
  SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS turns FROM turns GROUP BY conv_id),
-- crc32 of the decimal id: each character is added, and then its 8 bits are shifted out
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_concat([CAST(ord(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
         lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) % 4 AS h
  FROM ordered),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN ordered b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
named AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, list_transform(turns[1:depth], lambda t: t.d) AS node,
         CASE WHEN depth > 0 THEN turns[depth].w ELSE 0 END AS words FROM steps),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM named GROUP BY node, depth),
above AS (SELECT node, depth, (n_convs - 1) * words AS saved, n_convs, unnest(range(0, depth + 1)) AS up FROM nodes),
inner_nodes AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT a.node[1:a.up] AS node, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (i.node IS NULL) AS n_leaves
  FROM above a LEFT JOIN inner_nodes i ON a.node = i.node GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(i.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
       sha256(n.ids) AS ends_sha256
FROM nodes n JOIN sums s ON n.node = s.node LEFT JOIN inner_nodes i ON n.node = i.node
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """SQL of one round after the other: distances as |a|^2 - 2ab + |b|^2, exact for numbers this small."""
    steps = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT place, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x, list_inner_product(x, x) AS xx
  FROM kept, (SELECT unnest(range(4)) AS part)),
book0 AS MATERIALIZED (SELECT part, place AS entry, x AS e, xx AS ee FROM cut WHERE place < 256)"""
    for r in range(5):
        steps += f""",
near{r} AS MATERIALIZED (
  SELECT place, part, min({{'d': xx - 2 * list_inner_product(x, e) + ee, 'k': entry}}) AS n FROM cut JOIN book{r} USING (part) GROUP BY ALL)"""
        if r < 4:
            steps += f""",
sums{r} AS (
  SELECT part, entry, list(mean ORDER BY i) AS e FROM (
    SELECT part, n.k AS entry, i, floor(sum(x[i]) / count(*)) AS mean
    FROM near{r} JOIN cut USING (place, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM cut))) AS i) WHERE i <= len(x) GROUP BY ALL)
  GROUP BY part, entry),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.e, b.e) AS e, list_inner_product(coalesce(s.e, b.e), coalesce(s.e, b.e)) AS ee
  FROM book{r} b LEFT JOIN sums{r} s ON b.part = s.part AND b.entry = s.entry)"""
    return steps + """,
coded AS (
  SELECT place, string_agg(printf('%02x', n.k), '' ORDER BY part) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM near4 GROUP BY place),
told AS (
  SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM book4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (place), told
"""


OP13_SQL = _op13_sql()


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_files": op2_token_files,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_lm_score": op7_lm_score,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
    "op11_chat_format": op11_chat_format,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {"op3_mixing": OP3_SQL, "op11_chat_format": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}
