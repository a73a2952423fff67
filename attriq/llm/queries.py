"""The registered query of each operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attriq.llm import chat, language_model, minhash
from attriq.llm.common import crc_mod, cut, q, table
from attriq.llm.decontaminate import find_passages
from attriq.llm.imatch import compare_edited
from attriq.llm.line_dedup import drop_shared_lines
from attriq.llm.mixing import mix
from attriq.llm.prefix_trie import lend_starts, number_turns, prefix_nodes
from attriq.llm.quality import learn, score_quality
from attriq.llm.resampling import resample
from attriq.llm.secrets import find_secrets
from attriq.llm.simhash import near_duplicates
from attriq.llm.token_counts import count_tokens


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=20, documents=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL_1 = """
WITH lines AS (
  SELECT doc_id, t.line AS line, t.pos AS pos,
         translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents, UNNEST(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS t(line, pos)
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, (s.key IS NOT NULL AND s.keeper <> l.doc_id) AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = crc_mod(F.col("doc_id"), 7) == 2
    model = language_model.train(docs.filter(~out), order=3)
    scored = cut(language_model.score_texts(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    language_model.remove(spark, model)
    return scored


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0, label="quality", sample=8000)
    return score_quality(docs, model, threshold=0.3).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), errors=0.2, least=5)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    words = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    packs, members = chat.format_conversations(rows.unionByName(more), *words, pack_tokens=8192)
    return chat.with_members(chat.digests(chat.read_back(packs, *words)), members)


SQL_5 = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\1~', 'g')) + length(regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\1~', 'g')) AS escaped
  FROM every
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + escaped) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def text_of(spans: str) -> Column:
        return F.array_join(F.transform(q(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(text_of("base_spans"), 256).alias("base_sha256"), text_of("spans").alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), bits=4, shingle=4)


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"), high=0.01)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, weights=(5, 2, 1), percent=150, cap=2).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512, fit=True).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, size=10_000, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL_11 = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM steps WHERE k < 8
), crcs AS (
  SELECT list(v ORDER BY i) AS of_byte FROM steps WHERE k = 8
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), worded AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, row, UNNEST(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM worded
), counted AS (
  SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
         lambda a, b: xor(a >> 8, of_byte[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crcs
), totals AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain FROM totals
), weighed AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (f) JOIN gained USING (bucket) WHERE side = 0 GROUP BY row
), scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded d LEFT JOIN weighed USING (row) WHERE d.side = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100 THEN place END AS rank
FROM placed
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(number_turns(table(spark, sf_dir, "conversations")))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    nodes = prefix_nodes(cut(lend_starts(turns, convs, group=100, most=6)), convs)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL_12 = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM steps WHERE k < 8
), crcs AS (
  SELECT list(v ORDER BY i) AS of_byte FROM steps WHERE k = 8
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS len
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: xor(a >> 8, any_value(of_byte)[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM numbered, crcs GROUP BY conv_id
), placed AS (
  SELECT c.conv_id, b.pos, b.t, b.len FROM convs c JOIN numbered b ON b.conv_id = c.base AND b.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.t, o.len
  FROM convs c JOIN numbered o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN convs b ON b.conv_id = c.base
), paths AS (
  SELECT conv_id, pos AS depth, len, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), marked AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM marked GROUP BY path, depth
), born AS (
  SELECT left(path, 32 * (depth - 1)) AS parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN born b ON b.parent = n.path
), lines AS (
  SELECT left(path, 32 * i) AS top, saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM (SELECT *, UNNEST(range(0, depth + 1)) AS i FROM counted)
), summed AS (
  SELECT top, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM lines GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN summed s ON s.top = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))
"""


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=80, shingle=4)


SQL_13 = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT row, UNNEST(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM worded
), sizes AS (
  SELECT row, count(*) AS n FROM sets GROUP BY row
), met AS (
  SELECT a.row AS a, b.row AS b, count(*) AS common FROM sets a JOIN sets b USING (shingle) WHERE a.row < b.row GROUP BY ALL
), linked AS (
  SELECT a, b FROM met JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(row, root) AS (
  SELECT row, row FROM worded UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.row
), least AS (
  SELECT r.row, min(d.doc_id) AS component_id FROM reach r JOIN worded d ON d.row = r.root GROUP BY r.row
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id IS NOT DISTINCT FROM l.component_id AS kept
FROM worded d JOIN least l USING (row) LEFT JOIN sizes s USING (row)
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_secret_scans": op6_secret_scans,
    "op7_simhash": op7_simhash,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_minhash": op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": SQL_1,
    "op5_chat_formatting": SQL_5,
    "op11_importance_resampling": SQL_11,
    "op12_prefix_trie": SQL_12,
    "op13_minhash": SQL_13,
}
