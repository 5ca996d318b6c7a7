"""The queries of this subpackage's operators, and SQL for those it can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, bpe, chat, contamination, fim, html_text, langid, manifest, media, packing, simhash, token_files, toxicity
from quire.llm.common import held_out, table


def tokenizer_file(name: str) -> str:
    """A public tokenizer's vocabulary file; QUIRE_TOKENIZERS names another folder."""
    folder = os.environ.get("QUIRE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(0, 2, 1, 1).selectExpr(
        "cast(-7 as bigint) AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text"
    )
    events = chat.streamed(rows.unionByName(planted), "conv_id", "turn")
    found = chat.read_back(chat.render(chat.reconstruct(events)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, role = 'assistant' AS own,
         length(regexp_replace(text, '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>)', '_\1', 'g'))
         + length(replace(replace(replace(role, chr(92), '__'), chr(10), '__'), '<', '__')) + 9 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE own), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=0, capacity=2048)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.json"), keep=["doc_id"])


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_media(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return media.read_media(stored, keep=["doc_id", "n_bytes", "declared_type"])


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = manifest.manifest(docs, given={"text": manifest.without_breaks(F.col("doc_id"), F.col("text"))})
    found = found.withColumn("folded_root", manifest.fold(F.col("given"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


OP11_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, n: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS given, head
  FROM fields
), leaves AS (
  SELECT doc_id, leaf, sha256(head || coalesce(strlen(given) || ':' || given, '-')) AS given,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS m,
         row_number() OVER () AS r
  FROM hashed
), nodes AS (
  SELECT 0 AS k, g, i, m, leaf AS digest FROM leaves
  UNION ALL
  SELECT k + 1, g, i // 3, (any_value(m) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE m > 1 GROUP BY k, g, i // 3
), tops AS (
  SELECT 0 AS k, g AS i, (SELECT count(DISTINCT g) FROM leaves) AS m, digest FROM nodes WHERE m = 1
  UNION ALL
  SELECT k + 1, i // 3, (any_value(m) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE m > 1 GROUP BY k, i // 3
), runs AS (
  SELECT r, k, i // CAST(power(3, k) AS BIGINT) AS own, g FROM leaves, range(40) AS levels(k) WHERE m > power(3, k)
), steps AS (
  SELECT r, runs.k, coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i < own), '') AS before,
         coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i > own), '') AS after
  FROM runs JOIN nodes ON nodes.k = runs.k AND nodes.g = runs.g AND nodes.i // 3 = own // 3 GROUP BY r, runs.k
  UNION ALL
  SELECT r, 100 + tops.k, coalesce(string_agg(digest, '' ORDER BY tops.i) FILTER (WHERE tops.i < g // CAST(power(3, tops.k) AS BIGINT)), ''),
         coalesce(string_agg(digest, '' ORDER BY tops.i) FILTER (WHERE tops.i > g // CAST(power(3, tops.k) AS BIGINT)), '')
  FROM leaves JOIN tops ON tops.m > 1 AND tops.i // 3 = g // CAST(power(3, tops.k) AS BIGINT) // 3 GROUP BY r, tops.k
), paths AS (
  SELECT r, string_agg(before || after, '' ORDER BY k) AS proof, list(before || '|' || after ORDER BY k) AS path FROM steps GROUP BY r
), folded AS (
  SELECT doc_id, leaf, g, coalesce(proof, '') AS proof,
         list_reduce(list_prepend(given, coalesce(path, [])), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root
  FROM leaves LEFT JOIN paths USING (r)
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM folded JOIN (SELECT g, digest FROM nodes WHERE m = 1) s USING (g) CROSS JOIN (SELECT digest FROM tops WHERE m = 1) t
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination.scan(docs, items, keep=["doc_id"], locate=False)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), met AS (
  SELECT r, n, i, item_id FROM grams JOIN windows USING (n, gram)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM met)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT r, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    found = fim.restore(made)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT)) AS x FROM units
), cuts AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain'
              WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_simhash": op2_simhash,
        "op3_toxicity": op3_toxicity,
        "op4_token_files": op4_token_files,
        "op5_packing": op5_packing,
        "op6_main_text": op6_main_text,
        "op7_nearest": op7_nearest,
        "op8_language": op8_language,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_media_columns": op10_media_columns,
        "op11_manifest": op11_manifest,
        "op12_decontamination": op12_decontamination,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op11_manifest": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
