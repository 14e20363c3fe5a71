"""The queries of the training-data operators, by name.

Each applies one operator with its production parameters to its whole table.
Some have an SQL oracle, that is a brute-force version in DuckDB; all are tested
against brute force, round trips, libraries and held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clusters, decontaminate, langid, licenses, merkle, ngram_join, quality, repair, shards, suffixes, token_counts
from .common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """The pattern that cuts texts into pre-tokens."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digest_conversations(own.unionByName(extra), tokenizer_file("byte_bpe_50k.json")).drop("n_tokens", "loss_tokens")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(table(spark, sf_dir, "documents"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards(table(spark, sf_dir, "documents")).drop("bucket")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    """Every query of this subpackage."""
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


_SHINGLES = """t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM t),
k AS (SELECT doc_id, md5(array_to_string(g, '|')) AS k, len(g) AS n, g FROM s WHERE len(g) > 0),
sets AS (SELECT k, min(doc_id) AS least, count(*) AS n_copies, any_value(n) AS n, any_value(g) AS g FROM k GROUP BY k),
flat AS (SELECT least AS u, n, hash(unnest(g)) AS h FROM sets)"""

_OP2 = f"""WITH RECURSIVE {_SHINGLES},
pairs AS (SELECT a.u, b.u AS v FROM flat a JOIN flat b ON a.h = b.h AND a.u <> b.u GROUP BY a.u, b.u, a.n, b.n HAVING 1000 * count(*) >= 800 * (a.n + b.n - count(*))),
reach AS (SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v),
c AS (SELECT u, least(u, min(v)) AS class_id FROM reach GROUP BY u), l AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT s.doc_id, coalesce(c.class_id, x.least, s.doc_id) AS class_id, coalesce(l.n, 0) AS n_links, coalesce(x.n_copies, 1) AS n_copies, len(s.g) AS n_shingles
FROM s LEFT JOIN k USING (doc_id) LEFT JOIN sets x ON x.k = k.k LEFT JOIN c ON c.u = x.least LEFT JOIN l ON l.u = x.least"""

_OP7 = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
r AS (SELECT *, len(regexp_extract_all(role, '<\\\\*\\|')) + len(regexp_extract_all(text, '<\\\\*\\|')) + length(role) + length(text) + length('<|im_start|><|im_sep|><|im_end|>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id"""

_OP8 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (SELECT doc_id, n, pos, substr(h, 2 * pos + 1, 2098) AS g FROM (SELECT *, unnest(range(0, greatest(n - 49, 0), 1000)) AS pos FROM d)),
w AS (SELECT doc_id, pos + q AS p, hash(substr(g, 2 * q + 1, 100)) AS w FROM (SELECT *, unnest(range(0, least(1000, n - 49 - pos))) AS q FROM blocks)),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM w JOIN f USING (w) WHERE first < doc_id),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit) GROUP BY doc_id, k),
kept AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM span GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * b[i] + 1 END, CASE WHEN i = len(a) THEN 2 * d.n ELSE 2 * a[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE 2 * b[i] END)), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


_NEAREST = """n{0} AS MATERIALIZED (SELECT rid, CAST(min(d * 16 + c) % 16 AS INTEGER) AS c, CAST(min(d * 16 + c) // 16 AS BIGINT) AS d FROM
  (SELECT rid, c, CAST(list_sum(list_transform(list_zip(k.v, c{0}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM k, c{0}) GROUP BY rid)"""
_MOVED = """c{1} AS MATERIALIZED (SELECT c{0}.c, coalesce(m.v, c{0}.v) AS v FROM c{0} LEFT JOIN (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY p) AS v FROM
  (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM n{0} JOIN k USING (rid)) GROUP BY c, p) GROUP BY c) m USING (c))"""
_OP11 = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM k QUALIFY c < 16),
{", ".join(_NEAREST.format(i) + (", " + _MOVED.format(i, i + 1) if i < 3 else "") for i in range(4))}
SELECT vec_id, n3.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM n3 JOIN k USING (rid) JOIN c3 ON c3.c = n3.c"""


def _turn(x: str, by: str) -> str:
    """SQL that turns four bits to the right."""
    return f"((({x}) >> (({by}) % 4)) | (({x}) << (4 - (({by}) % 4)))) & 15"


def _descent(k: int) -> str:
    """SQL of one level down the curve: from entry, direction and index to the
    next ones (w: the corner's place, by the inverse Gray code)."""
    corner = " + ".join(f"((({c}_cell >> {3 - k}) & 1) << {i})" for i, c in enumerate(shards.DIMENSIONS))
    turned = _turn(f"xor({corner}, e)", "d + 1")
    entry = "CASE WHEN w = 0 THEN 0 ELSE xor((w - 1) // 2 * 2, (w - 1) // 2) END"
    return f"""w{k} AS (SELECT *, xor(xor(l, l >> 1), xor(l >> 2, l >> 3)) AS w FROM (SELECT *, {turned} AS l FROM h{k})),
h{k + 1} AS (SELECT * EXCLUDE (e, d, idx, w, l), xor(e, {_turn(entry, "3 - d")}) AS e, (d + 1 + CASE WHEN w = 0 THEN 0 ELSE [0, 1, 0, 2, 0, 1, 0, 3, 0, 1, 0, 2, 0, 1, 0, 4][CASE WHEN w % 2 = 1 THEN w ELSE w - 1 END + 1] % 4 END) % 4 AS d, idx * 16 + w AS idx FROM w{k})"""


def _cells(c: str) -> str:
    """SQL of a dimension's bins and of the share of rows before each."""
    return f"""{c}_ends AS (SELECT min({c}_key) AS a, (max({c}_key) - min({c}_key)) // 4096 + 1 AS w FROM keys),
{c}_bins AS (SELECT rid, coalesce({c}_key // w - a // w, 0) AS bin FROM keys, {c}_ends),
{c}_cells AS (SELECT rid, CAST(((rank() OVER (ORDER BY bin) - 1) * 16) // (SELECT count(*) FROM rows_) AS INTEGER) AS {c}_cell FROM {c}_bins)"""


def _word_key(c: str) -> str:
    same = f"(SELECT max(i) FROM (SELECT min(hex(encode({c}))) AS a, max(hex(encode({c}))) AS b FROM rows_), range(0, 100000) t(i) WHERE i <= least(length(a), length(b)) // 2 AND left(a, 2 * i) = left(b, 2 * i))"
    return f"CAST('0x' || rpad(substr(hex(encode({c})), 2 * {same} + 1, 12), 12, '0') AS BIGINT) AS {c}_key"


_OP12 = f"""WITH tab AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
rows_ AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, tab),
keys AS MATERIALIZED (SELECT rid, doc_id, size, text_crc32, {_word_key("source")}, {_word_key("lang")}, 64 * length(bin(size)) + ((size * 64) >> (length(bin(size)) - 1)) AS size_key, doc_id AS doc_id_key FROM rows_),
{", ".join(map(_cells, shards.DIMENSIONS))},
h0 AS (SELECT rid, doc_id, size, text_crc32, {", ".join(f"{c}_cell" for c in shards.DIMENSIONS)}, 0 AS e, 0 AS d, CAST(0 AS BIGINT) AS idx FROM keys {" ".join(f"JOIN {c}_cells USING (rid)" for c in shards.DIMENSIONS)}),
{", ".join(map(_descent, range(4)))},
p AS (SELECT *, row_number() OVER (ORDER BY idx, CAST('0x' || left(md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(text_crc32 AS VARCHAR))), 8) AS BIGINT) % 4096, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM h4)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 16 // n AS INTEGER) AS shard, CAST(place - (place * 16 // n * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(idx AS BIGINT) AS hilbert FROM p"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that it can express whole."""
    return {"op2_ngram_join": _OP2, "op7_chat_format": _OP7, "op8_suffix_dedup": _OP8, "op11_dual_tree_clusters": _OP11, "op12_hilbert_shards": _OP12}
