"""URL filters: block and allow rules for a host, its subdomains and a start of the path.

A URL is expanded into expressions: every suffix of its host that starts at a label, with every start of
its path, as far as a rule has a host and a path of these lengths. Expressions and rules meet in an
equi-join on the first bytes of their SHA-256; the full digest confirms a meeting, and of the rules that fit
the longest decides (ties: the longer host, then block before allow).

What a URL is expanded to depends on its host and the first characters of its path only, as many as the
longest rule path has. URLs are reduced to these pairs before anything is joined, so a host with a third
of all pages is judged once. Only pairs that some rule fits go back to the URLs. No side is broadcast by
hint; Spark broadcasts the rules or the verdicts where their size, known or measured, is below its
threshold, and otherwise sorts and merges, splitting large keys.

Null or malformed URLs (no ``://``) have an empty host and path, which no rule fits. URLs are taken
whole; repeated rows stay repeated; an empty table gives an empty one. Rules that are null in a part, or
that repeat, are left out. Existing columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that expressions and rules are joined on.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows."""
    return spark.createDataFrame(rules, RULES)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """Of host and path; the line end between them is in no host."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """Structs (host, path) of the suffixes and starts that have one of the pairs of lengths."""
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in lengths])
    whole = F.length(host)

    def fits(pair: Column) -> Column:
        edge = (pair["h"] == whole) | (F.substring(host, whole - pair["h"], F.lit(1)) == ".")
        return (pair["h"] <= whole) & (pair["p"] <= F.length(path)) & edge

    return F.transform(F.filter(pairs, fits), lambda pair: F.struct(
        F.substring(host, whole - pair["h"] + 1, pair["h"]).alias("host"),
        F.substring(path, F.lit(1), pair["p"]).alias("path")))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (host and path joined; null if none fits) and verdict."""
    spark = df.sparkSession
    rules = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))  # block before allow
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(*[df[f"`{c}`"] for c in kept], host_of(df[url]).alias("host"), path_of(df[url]).alias("path"))
    # Distinct lengths, of which there are few however many rules there are.
    lengths = sorted(tuple(r) for r in rules.select(F.length("host"), F.length("path")).distinct().collect())
    if not lengths:
        return parts.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    longest = max(p for _, p in lengths)
    parts = parts.withColumn("__start__", F.substring("path", 1, longest))
    pairs = parts.select("host", "__start__").distinct()
    expanded = pairs.select(
        "host", "__start__", F.explode(expressions(F.col("host"), F.col("__start__"), lengths)).alias("e"))
    expanded = expanded.withColumn("digest", digest(F.col("e.host"), F.col("e.path")))
    listed = rules.select(
        digest(F.col("host"), F.col("path")).alias("listed"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"), "verdict")
    met = expanded.join(
        listed, F.substring(expanded["digest"], 1, PREFIX) == F.substring(listed["listed"], 1, PREFIX))
    met = met.where(F.col("digest") == F.col("listed"))
    order = F.struct(F.length("rule"), "host_length", "verdict")
    best = met.groupBy(met["host"].alias("best_host"), met["__start__"].alias("best_start")).agg(
        F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    joined = parts.join(
        best, (parts["host"] == best["best_host"]) & (parts["__start__"] == best["best_start"]), "left")
    return joined.select(
        *[parts[f"`{c}`"] for c in kept], parts["host"], parts["path"], F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"))
