"""One query for each text operator, over the whole of its table, with the operator's production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import chat_format, decontaminate, divergence, filter_audit, katz, lattice_sample, quality_cnn, secret_scan, simhash, spotsigs, token_count, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(folds: int) -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % folds


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    whole = chat_format.format_turns(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    back = chat_format.read_back(whole)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voters, _, linear = toxicity_model(spark, sf_dir, docs)
    scored = toxicity.score(docs, voters, linear)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_sample.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("all_spans")).alias("spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_item_word", "longest_word")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = quality_cnn.score(docs, quality_cnn.fit(docs, labels))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score(table(spark, sf_dir, "documents"), train=fold(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_chat_format, op3_toxicity, op4_simhash, op5_sentencepiece, op6_secret_scan, op7_decontaminate, op8_token_count, op9_quality, op10_spotsigs, op11_divergence, op12_katz, op13_filter_audit)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM parts
), rules(rh, rp, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM cut JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT cut.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM cut LEFT JOIN best USING (page_id)
"""

_CONTROL = chat_format.CONTROL
ORACLE_SQL["op2_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')) AS v(conv_id, turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '([<\\[])(~*){_CONTROL}', '\\1~\\2\\3', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLE_SQL["op11_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (g.n + v) AS HUGEINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + v) AS HUGEINT) AS ql
  FROM groups AS g JOIN kept AS k ON g.lang = k.lang JOIN langs AS l ON l.lang = g.lang LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - ql) * (p - ql)) // ql AS BIGINT) AS value FROM shares WHERE c > 0 AND p > ql
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""

ORACLE_SQL["op13_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), masks AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f FROM words
), counts AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1) USING (doc_id) GROUP BY ALL
), letter(i) AS (VALUES (1), (2), (3), (4), (5)
), perm AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT part, o, i AS step, o[i] AS own,
    sum(CASE WHEN NOT list_bool_or([f[x] FOR x IN o[1:i]]) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN f[o[i]] AND NOT coalesce(list_bool_or([f[x] FOR x IN o[1:i - 1]]), false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN f[o[i]] AND coalesce(list_bool_or([f[x] FOR x IN o[1:i - 1]]), false) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f[o[i]] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN f[o[i]] AND NOT coalesce(list_bool_or([f[x] FOR x IN o[1:i - 1]]), false) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN f[o[i]] AND NOT coalesce(list_bool_or([f[x] FOR x IN o[1:i - 1]]), false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, perm, letter GROUP BY ALL
)
SELECT part, array_to_string([chr(64 + x) FOR x IN o], '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM steps
"""
