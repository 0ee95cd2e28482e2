"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.llm import bpe, chat_format, embedding_dedup, fingerprints, importance, language_id, line_dedup, merkle, mixing, scratch, secret_scan, sentencepieces, simhash, token_files
from groundloom.llm.batches import keep_batches_small

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_SIZE = 50_257
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    keep_batches_small(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch.new_path(spark, "token-files")
    token_files.write(_read(spark, sf_dir, "documents"), out, BYTE_BPE, end_id=2, vocabulary_size=BYTE_BPE_SIZE)
    return token_files.read_documents(spark, out, ids=False)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(_read(spark, sf_dir, "conversations"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"), BYTE_BPE_RANKS, public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), BYTE_BPE)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"), mixing.order_key().alias("key"))
    sized = scratch.table(docs, "sizes")
    return mixing.assign(sized).select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op11_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(_read(spark, sf_dir, "documents"), PIECE_BPE)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"), merkle.newlines_deleted())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_files, op2_chat_format, op3_secret_scan, op4_language_id, op5_simhash, op6_line_dedup, op7_embedding_dedup, op8_bpe_round_trip, op9_mixing, op10_fingerprints, op11_sentencepiece_round_trip, op12_importance_resampling, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": CHAT_FORMAT,
        "op6_line_dedup": LINE_DEDUP,
        "op7_embedding_dedup": EMBEDDING_DEDUP,
        "op9_mixing": MIXING,
        "op12_importance_resampling": IMPORTANCE,
        "op13_merkle_manifest": MERKLE,
    }


CHAT_FORMAT = """
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, 'unknown') || chr(31) || coalesce(text, ''))) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations),
chained AS (
  SELECT *, md5(string_agg(md5(role || chr(31) || text), ',') OVER (PARTITION BY conv_id ORDER BY place)) AS h FROM turns),
whole AS (
  SELECT n_turns, h, min(conv_id) AS conv_id, count(*) AS n_logged FROM chained WHERE place = n_turns GROUP BY n_turns, h),
kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM chained c WHERE c.place < c.n_turns AND c.place = w.n_turns AND c.h = w.h))
SELECT k.conv_id, k.n_turns, k.n_logged,
  string_agg('<|im_start|>' || t.role || chr(10) || replace(t.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY t.place) AS rendered
FROM kept k JOIN turns t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_logged
"""

LINE_DEDUP = """
WITH each AS (
  SELECT doc_id, source, line, trim(line, ' ' || chr(9) || chr(13)) AS core, place FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents WHERE text IS NOT NULL)),
shared AS (
  SELECT core, min(doc_id) AS first FROM each WHERE core <> '' GROUP BY core HAVING count(DISTINCT coalesce(source, '')) >= 5),
marked AS (
  SELECT e.*, s.core IS NOT NULL AND NOT (e.doc_id = s.first AND e.place = min(e.place) OVER (PARTITION BY e.doc_id, e.core)) AS gone
  FROM each e LEFT JOIN shared s USING (core)),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT m.vec_id, coalesce(c.n_links, 0) AS n_links, l.component_id, m.vec_id = l.component_id AS kept
FROM embeddings m JOIN least l ON l.a = m.vec_id LEFT JOIN counts c ON c.a = m.vec_id
"""

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || sha256(coalesce(text, '')))) AS k
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM docs GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER w AS place,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM per WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
free AS (
  SELECT place, rest, weight_left FROM ranked WHERE cap * weight_left >= rest * weight ORDER BY place LIMIT 1),
targets AS (
  SELECT r.source, r.source_size, CASE WHEN r.place < f.place THEN r.cap::DOUBLE ELSE (f.rest * r.weight)::DOUBLE / f.weight_left::DOUBLE END AS target
  FROM ranked r, free f),
placed AS (
  SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start,
    floor(t.target + 0.5)::BIGINT AS budget
  FROM docs d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_epochs FROM placed)
SELECT doc_id, size, source_size, target,
  (full_epochs * size + least(greatest(budget - full_epochs * source_size - start, 0), size))::BIGINT AS taken
FROM epochs
"""

#: CRC-32 of texts (a table `wanted` of w), byte by byte, as a table `crc` of w and c.
CRC = """
steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
coded AS (
  SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(encode(w)), (2 * i + 1)::BIGINT, 1)) - 1)
    + instr('0123456789ABCDEF', substr(hex(encode(w)), (2 * i + 2)::BIGINT, 1)) - 1) AS bytes
  FROM wanted),
crc AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1])), 4294967295) AS c FROM coded, steps)"""

IMPORTANCE = (
    r"""
WITH texts AS (
  SELECT doc_id, 0 AS kind, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
words AS (
  SELECT doc_id, kind, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
counted AS (SELECT kind, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
wanted AS (SELECT DISTINCT w FROM counted),"""
    + CRC
    + """,
buckets AS (SELECT w, c % 10000 AS bucket FROM crc),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0)::BIGINT AS t
  FROM counted JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT + 10000 AS s_all, sum(t)::BIGINT + 10000 AS t_all FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * s_all::DOUBLE) / ((s + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS gain FROM sums, totals),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM counted JOIN buckets USING (w) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
hashed AS (
  SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(sha256('2024:' || doc_id::VARCHAR), 1, 8), ''), lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT)), lambda a, x: 16 * a + x) AS h
  FROM documents),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id) JOIN hashed USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.*, r.rank FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.rank <= 10 * r.n // 100
"""
)

MERKLE = (
    """
WITH RECURSIVE wanted AS (SELECT DISTINCT doc_id::VARCHAR AS w FROM documents WHERE doc_id IS NOT NULL),"""
    + CRC
    + """,
given AS (
  SELECT doc_id, source, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS front,
    text, CASE WHEN c % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents LEFT JOIN crc ON w = doc_id::VARCHAR),
rows_ AS (
  SELECT doc_id, source, sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(octet_length(encode(tampered)) || ':' || tampered, '-')) AS found
  FROM given),
placed AS (
  SELECT *, coalesce('1' || source, '0') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM rows_),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, (min(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3),
subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT '' AS tree, 0 AS level, pos, n, node FROM subroots
  UNION ALL
  SELECT tree, level + 1, pos // 3, (min(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY tree, level, pos // 3),
beside AS (
  SELECT tree, level, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (FROM nodes UNION ALL FROM upper_nodes) WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)),
path AS (
  SELECT row_number() OVER () AS id, tree, 0 AS level, pos, found AS node, '' AS proof FROM placed
  UNION ALL
  SELECT id, tree, level + 1, pos // 3, sha256(before || node || after), proof || before || after FROM path JOIN beside USING (tree, level, pos)),
half AS (SELECT id, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM path GROUP BY id),
ids AS (SELECT id, tree, pos FROM path WHERE level = 0),
upper_path AS (
  SELECT h.id, '' AS tree, 0 AS level, s.pos, h.node, h.proof FROM half h JOIN ids i USING (id) JOIN subroots s ON s.tree = i.tree
  UNION ALL
  SELECT id, tree, level + 1, pos // 3, sha256(before || node || after), proof || before || after FROM upper_path JOIN beside USING (tree, level, pos)),
whole AS (SELECT id, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM upper_path GROUP BY id),
top AS (SELECT node AS root FROM upper_nodes WHERE n = 1)
SELECT p.doc_id, p.leaf, s.node AS subroot, root, sha256(w.proof) AS proof_sha256, w.folded_root, w.folded_root = root AS verified
FROM placed p JOIN ids i ON i.tree = p.tree AND i.pos = p.pos JOIN whole w ON w.id = i.id JOIN subroots s ON s.tree = p.tree, top
"""
)
