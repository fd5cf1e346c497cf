"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apptledger.llm import bpe, html, licenses, mixing, neardup, quality, runs, secrets, setjoin, topk, unigram, urlrules, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(documents).drop("text"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_bytes", "n_packed", F.size("chunk_bytes").cast("long").alias("n_chunks"), "n_bad_chunks")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op4_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = mixing.rates(documents, table(spark, sf_dir, "labels"))
    return rated.select(
        "doc_id", "n_words", *[f"p_{d}" for d in mixing.DOMAINS], "rate",
        mixing.copies(F.col("rate"), "doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("copies"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors, k=5)


#: (host, path, verdict) of the registered query.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlrules.judge(pages, urlrules.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return spans.select(
        "doc_id", *map(number, secrets.KINDS[:3]), F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"), number("random"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.try_element_at("matches", F.lit(1))
    return scanned.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"),
        best["dice"].alias("dice"), best["n_bigrams"].cast("long").alias("n_bigrams"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(embeddings)
    rows = whitening.whitened(embeddings, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def altered_words(values: pa.Array) -> Iterator[list[bytes]]:
    """Words of (text, hash) pairs; every tenth hash has the words from a place on repeat themselves."""
    for words, value in zip(runs.words_of(values.field("text")), values.field("hash"), strict=True):
        count, value = len(words), value.as_py()
        if count and value is not None and value % 10 == 0:
            seed = value // 10
            at = seed % count
            period = 1 + (count - at) // (3 + seed % 8)
            words[at:] = [words[at + i % period] for i in range(count - at)]
        yield words


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct("text", F.crc32(F.col("doc_id").cast("string")).alias("hash")).alias("runs"))
    found = runs.repeats(documents, "runs", altered_words)
    # The greatest length first, of these the smallest start, then period.
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("longest"))
    length = -F.col("longest.shorter")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * -longest.shorter div longest.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_compression": op2_compression,
    "op3_token_counts": op3_token_counts,
    "op4_minmax_neardup": op4_minmax_neardup,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_url_rules": op7_url_rules,
    "op8_main_text": op8_main_text,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_runs": op12_runs,
    "op13_set_join": op13_set_join,
}

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_sql() -> str:
    rules = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)})" for h, p, v in URL_RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
split AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER_LOWER}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (
    PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT r, rule, v FROM fits WHERE place = 1) USING (r)"""


def license_sql() -> str:
    listed = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in sorted(licenses.TEMPLATES.items()))
    words = f"regexp_extract_all(translate(body, {UPPER_LOWER}), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    least = licenses.THRESHOLD / (2 - licenses.THRESHOLD)
    return f"""
WITH listed(license, body) AS (VALUES {listed}),
templates AS (SELECT license, {pairs} AS t FROM (SELECT license, {words} AS w FROM listed)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
passages AS (
  SELECT r, unnest(string_split(text, chr(10))) AS body FROM docs
  UNION SELECT r, unnest(regexp_split_to_array(text, '\n[\x20\t\r]*\n')) FROM docs
  UNION SELECT r, text FROM docs),
cut AS (SELECT r, {pairs} AS p FROM (SELECT r, {words} AS w FROM passages)),
scored AS (
  SELECT r, license, len(p) AS n_bigrams, 2 * len(list_intersect(p, t)) / (len(p) + len(t)) AS dice
  FROM cut JOIN templates ON len(p) >= {least} * len(t) AND len(p) * {least} <= len(t)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY r) AS n_matches, row_number() OVER (
    PARTITION BY r ORDER BY dice DESC, n_bigrams DESC, license) AS place
  FROM scored WHERE dice >= {licenses.THRESHOLD})
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, license, dice, n_bigrams::BIGINT AS n_bigrams
FROM docs LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (r)"""


#: Where SQL can express a query over whole tables. tests/llm holds the others against brute force or a round trip.
SQL: dict[str, str] = {
    "op7_url_rules": url_sql(),
    "op10_licenses": license_sql(),
}
