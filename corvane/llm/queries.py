"""The queries of this subpackage over the given tables, and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, brown, chat, decontaminate, fingerprints, langid, lines, simhash, substrings, toxicity
from corvane.llm._common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, rest: int) -> Column:
    """Documents that nothing is learnt from; one without an id is none of them, and nothing is learnt from it either."""
    return F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False)).alias("held_out")


def _sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")
    numbers = F.array_join(F.col("removed").cast("array<string>"), ",")
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), _sha(numbers).alias("removed_sha256"), _sha(F.col("kept")).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", *vocabulary, decoded="decoded")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), _sha(ids).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(added))
    formatted = chat.format_records(chat.gathered(rows, "conv_id", "turn", "role", "text"), "record").drop("record")
    read = chat.masked_text(chat.read_back(formatted))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(lines).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        _sha(F.col("loss_text")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), _sha(F.col("kept")).alias("kept_sha256"))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = brown.fit(docs.where(remainder("doc_id", 7) != 2), "text")
    found = brown.score(docs.select("doc_id", "text", _held_out(7, 2)), "text", model)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_next(_table(spark, sf_dir, "documents"), "doc_id", "text")
    replaced = F.floor(F.col("n_chars") / 3).cast("int")
    found = found.withColumn("n_chars", F.char_length("text").cast("long"))
    found = found.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - replaced), F.substring("next_text", F.lit(1), replaced)))
    found = fingerprints.with_fingerprint(found.drop("text", "next_text"), "edited", "edited_print")
    digest = lambda c: F.sha2(F.concat_ws("|", F.array_join(c["hashes"].cast("array<string>"), " "), F.array_join(c["places"].cast("array<string>"), " ")), 256)
    own, edited = F.col("fingerprint"), F.col("edited_print")
    return found.select(
        "doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), digest(own).alias("fingerprint"), digest(edited).alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"), fingerprints.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    found = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), "hit_items")
    return found.select("doc_id", "n_words", "n_hit", "n_items", _sha(F.array_join("hit_items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = langid.fit(docs.where(remainder("doc_id", 4) != 2), "text", "lang", "doc_id")
    found = langid.predict(docs.select("doc_id", "text", _held_out(4, 2)), "text", prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, "doc_id", "text", _table(spark, sf_dir, "labels"), "doc_id", "toxic", lambda c: remainder(c, 3) != 1)
    found = toxicity.score(docs, "text", model)
    return found.select("doc_id", _held_out(3, 1), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_chat_format, op4_simhash, op5_substrings, op6_brown_lm, op7_winnowing, op8_decontaminate, op9_langid, op10_toxicity)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_MARKS = "|".join((r"\|", "/?s>", "/?SYS>", "unk>", "pad>", "mask>", "[be]os>", "start_of_turn>", "end_of_turn>", *(rf"/?{w}\]" for w in ("INST", "TOOL_CALLS", "TOOL_RESULTS", "AVAILABLE_TOOLS", "SYSTEM_PROMPT"))))
_ESCAPES = rf"len(regexp_extract_all({{}}, '[<\[]\\*({_MARKS})'))"

ORACLES = {
    "op3_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role))
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(23 + length(role) + length(text) + {_ESCAPES.format("role")} + {_ESCAPES.format("text")})::BIGINT AS formatted_chars,
            CASE WHEN (conv_id % 5 + 5) % 5 = 4 AND string_agg(role, ',' ORDER BY turn, role, text) IN ('user,assistant', 'system,user,assistant') THEN 'prompt'
                ELSE CASE (conv_id % 5 + 5) % 5 WHEN 1 THEN 'message texts' WHEN 2 THEN 'dialogue' WHEN 3 THEN 'nested data' ELSE 'messages' END END AS layout
        FROM c GROUP BY conv_id""",
    "op5_substrings": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        g AS (SELECT doc_id, i, b[i:i + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)),
        first AS (SELECT s, min(doc_id) AS f FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT DISTINCT doc_id, i FROM g JOIN first USING (s) WHERE doc_id > f),
        steps AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hits),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM steps) GROUP BY doc_id, k),
        ends AS (SELECT doc_id, coalesce(max(z), 0) + 1 AS p, max(n) AS q, coalesce(sum(z - a + 1), 0) AS n_removed, count(z) AS n_spans FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
        parts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS p, a - 1 AS q FROM runs UNION ALL SELECT doc_id, p, q FROM ends),
        kept AS (SELECT doc_id, string_agg(hex(b[p:q]), '' ORDER BY p) AS h FROM parts JOIN d USING (doc_id) WHERE q >= p GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
        FROM d JOIN ends USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORDS}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORDS}') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, s)),
        marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
