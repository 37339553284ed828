"""One registered query per operator, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowndate.llm import (
    ann, chat, hard_negatives, jaccard_join, mixing, packing, periodic_runs, quality_rules, relative_lz, secret_scan, subword_quality,
    suffix_dedup, toxicity,
)
from knowndate.llm.frames import let, table, words_of, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query(
    "op1_quality_rules",
    r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM w),
grams AS (
  SELECT r, unnest(range(1, len(ws) - 6)) AS i,
         unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g
  FROM numbered WHERE len(ws) >= 8),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
  FROM numbered LEFT JOIN covered USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END) + (CASE WHEN 2 * n_exclaims > n_words THEN 64 ELSE 0 END)
    + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS failed_bits
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_bits = 0 AS kept,
       CAST(failed_bits AS BIGINT) AS failed_bits
FROM b""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.apply_policy(rows, "base-1")).alias("base_failed"),
        quality_rules.apply_policy(rows, "full-1").alias("kept"),
        "failed_bits",
    )


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), mixing.DOMAINS)
    mixed = written(mixing.with_posteriors(docs, model).drop("text"))
    steps = mixing.fit_rates(mixed, mixing.DOMAINS, mixing.TARGETS)
    return mixing.with_rates(mixed, steps).select(
        "doc_id", "tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)], "rate", "copies"
    )


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), jaccard_join.Likeness(words=3, at_least=90))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query("op6_multi_index_ann")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op8_relative_lz")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.dedup(table(spark, sf_dir, "documents"))


#: A conversation that holds the template's own control strings.
CONFLICT = "</s>[INST] ok [/INST]"


@query(
    "op9_chat_format",
    r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_matches(role || ' ' || text, '<s>|</s>|\[INST\]|\[/INST\]|<esc>') OR contains(text || ' [/INST]', ' [/INST] [/INST]') AS clash,
         length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) AS safe FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, bool_or(clash) AS escaped,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + 22) AS plain_chars, sum(safe + 22) + 5 AS safe_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(CASE WHEN escaped THEN safe_chars ELSE plain_chars END AS BIGINT) AS formatted_chars,
       escaped, TRUE AS round_trip
FROM g""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    done = chat.format_chats(given.unionByName(extra))
    done = done.withColumn("loss", chat.loss_text(F.col("formatted")))
    loss = F.col("loss")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "round_trip",
    )


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def looped(doc_id, text):
    """The text with the words from some place on replaced by a period of its own, for one id in ten (by its CRC)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def loop(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + F.pmod(i - a, p))))

    some = F.coalesce(h % 10 == 0, F.lit(False)) & F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return F.when(some, F.array_join(let(words_of(text), loop), " ")).otherwise(text)


@query(
    "op11_periodic_runs",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS digits,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
crc AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(digits, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM d),
places AS (SELECT *, len(ws) AS n, coalesce((h // 10) % greatest(len(ws), 1), 0) AS a, h // 10 AS g FROM crc),
periods AS (SELECT *, CASE WHEN h % 10 = 0 THEN 1 + (n - a) // (3 + g % 8) ELSE n + 1 END AS p FROM places),
texts AS (
  SELECT r, doc_id, n, list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) AS ws
  FROM periods),
words AS (SELECT r, unnest(range(0, n)) AS i, unnest(ws) AS w FROM texts),
same AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i),
islands AS (
  SELECT r, q, min(i) AS s, count(*) + q AS l
  FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same)
  GROUP BY r, q, g HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (
  SELECT * FROM islands x WHERE NOT EXISTS (
    SELECT 1 FROM islands y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said,
         arg_min({'s': s, 'l': l, 'q': q}, {'a': -l, 'b': s, 'c': q}) AS top
  FROM runs GROUP BY r),
gone AS (
  SELECT DISTINCT r, i FROM (SELECT r, unnest(range(s + q, s + l)) AS i FROM runs)),
kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS said FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length,
       CAST(top.q AS BIGINT) AS period, CAST(1000 * top.l // top.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(told.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (r) LEFT JOIN kept USING (r)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.find_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    said = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    longest = -F.col("top.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"),
        F.sha2(F.concat(F.array_join(said, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), longest.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * longest / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query(
    "op12_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, x.vec_id, x.label, CAST(list_dot_product(a.e, x.e) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("id") % 100 == 0)


@query("op13_subword_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = subword_quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return subword_quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )
