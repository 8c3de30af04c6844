"""The registered queries of the operators: thin adapters from the tables to each contract, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import chat, decontam, langid, packing, phrases, pieces, quality, rules, sharding, simhash, tokencount, warc, whitening
from caseweave.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of encoded texts."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(joined, 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


@query("op1_pieces")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_digests(pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))).drop("text")


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = quality.classify(docs, table(spark, folder, "labels"), quantile=0.995, slack=1.05)
    return judged.select("doc_id", F.round("perplexity", 4).alias("perplexity"), "kept")


@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("bm25", "overlap", "question_overlap", "answer_overlap")])


@query(
    "op5_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
coded AS (
  SELECT *, list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * k::INT, 5))::INT >> (15 - 5 * j)::INT) & 31), 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM coded
""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), least_bytes=0)


@query("op6_rendezvous")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_records(table(spark, folder, "documents"), weights=(1.0,) * 8)


@query(
    "op7_chat",
    r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g') AS safe FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + 1 + length(safe) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END)::BIGINT AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    two = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role")) for n, role in enumerate(("user", "assistant"))]))
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), two.alias("t")).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    back = chat.read_back(stage(chat.format_conversations(turns.union(added))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


#: The ledger of all documents in SQL.
LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i,
  unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS part FROM w WHERE len(words) >= 5),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, part) AS times FROM k),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM v WHERE times > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END) | (CASE WHEN n_dup_lines > 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END)
    | (CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END) AS failed
  FROM m)"""


@query("op8_rules", LEDGER_SQL + "\nSELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rules.judge(rules.ledger(rules.measure(docs)), version=2).drop("text")


@query(
    "rule_ablations",
    LEDGER_SQL
    + """,
r AS (SELECT unnest(['few_words', 'repeated_words', 'many_symbols', 'repeated_lines', 'word_length', 'mostly_capitals']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, count(*) FILTER (WHERE (failed & bit) <> 0) AS failing, count(*) FILTER (WHERE failed = bit) AS alone FROM r LEFT JOIN f ON true GROUP BY rule""",
)
def rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rules.ablations(rules.ledger(rules.measure(docs)), version=2)


def held_out():
    """Whether a document is kept from training the language model."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_model(docs: DataFrame) -> langid.Model | None:
    """The language model of the documents that may be learnt from."""
    return langid.learn(docs.filter(~held_out()))


@query("op9_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    named = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "rejected")


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query(
    "op11_phrases",
    r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS x, substr(phrase, length(w[1]) + 2) AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, sub, max(a) AS m FROM (
  SELECT lang, a, w[1] || ' ' || w[2] AS sub FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3) GROUP BY lang, sub),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND sub = phrase WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=10, max_words=3, top=2000, within_percent=50)


@query("op12_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"), components=4, scale=256, weights="distinct")
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
