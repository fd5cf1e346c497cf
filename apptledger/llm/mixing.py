"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier learned from the ``labels`` table gives every document a posterior over domains; the document
counts towards each domain by its words times its posterior. Rates per document, none negative, are fitted so
that the expected words of each domain come closest to the targets: least squares over domains, by
projected gradient steps whose sums run on the cluster. A document that is ``STAYS`` or more of the reference domain has a
rate of 1 at least, as a bound of the fit, so it always stays and the targets are met with it. Copies are whole numbers whose mean is the rate.

Domains (``DOMAINS``): ``toxic`` for a document labelled toxic, else ``good`` or ``poor`` by its quality label. The
reference domain keeps its words and the targets of the others follow from the weights.

Classifier: naive Bayes over which tokens a text has and lacks. Tokens are its distinct words in lower
case, single signs, and one for how often words recur at its length. It is learned from about ``SAMPLE``
labelled rows, picked by a hash of their ids, that bound being a parameter. Tokens on ``LEAST_TEXTS`` texts or more
that are ``LIFT`` times as frequent in some domain as overall, with a likelihood ratio against chance of ``LEAST_RATIO``, are
features, the ``FEATURES`` best ones at most, so the model that is broadcast has a fixed bound.

Steps: with words ``t`` and posterior ``p`` of a text, its own rate moves against ``sum_k p_k e_k / s_k`` and is cut at its least value, where
``e_k`` is domain k's surplus of words and ``s_k`` the words it has. In this metric the step length 1 is safe, since
the matrix ``sum t p p' / s`` has row sums of 1. Steps carry on the last one's movement (accelerated gradient, begun anew whenever the
squares grow). Fitting ends at the optimum: when another plain step would change the kept words by less than ``TOLERANCE`` of
all words; how far it would is returned as well, should ``STEPS`` not suffice. Rates are stored every ``STORE_EVERY`` steps.
Equal texts are one row here, however many there are. ``cells`` sums texts of like posteriors up for a look at a corpus; no rate is made of it.

Null and empty texts have no words and no tokens; their posterior and rate follow from that. Without
labelled texts nothing tells domains apart: every posterior is even, and every rate 1. Labels that
are null, or without a document, do not count; of labels that repeat a document the least one counts. Rows are kept as they are, repeated ones too, in ``rates``;
an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptledger.llm.neardup import checked_broadcast
from apptledger.session import materialized

DOMAINS = ("good", "poor", "toxic")
REFERENCE = "good"
WEIGHTS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}
SAMPLE, FEATURES, LEAST_TEXTS, LIFT, LEAST_RATIO = 20_000, 1024, 5, 2.0, 10.0
STEPS, STORE_EVERY, TOLERANCE = 60, 20, 3e-5
#: Marks between which ``cells`` adds up texts.
GRID = 50
#: A document that belongs to the reference domain at least this much stays at least once.
STAYS = 0.5


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def tokens(text: Column, words: Column) -> Column:
    """Distinct words and signs, and the share of distinct ones in fifths by the logarithm of the length to base 4."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\s\p{L}\p{N}]"), F.lit(0)))
    least = F.greatest(words, F.lit(1))
    recurring = F.concat_ws("/", F.floor(5 * F.size(found) / least), F.floor(F.log(4.0, least)))
    return F.when(words > 0, F.concat(found, F.array(F.concat(F.lit("~"), recurring))))


def domain(quality: Column, toxic: Column) -> Column:
    """Number of the domain in ``DOMAINS``."""
    return F.when(toxic == 1, F.lit(2)).when(quality == 1, F.lit(0)).when(quality == 0, F.lit(1))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(domain, tokens) of about ``sample`` labelled documents."""
    numbered = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain")).dropna()
    numbered = numbered.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, sample / max(1, numbered.count()))
    picked = numbered.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return docs.select("doc_id", "text").join(checked_broadcast(picked), "doc_id").select(
        "domain", tokens(F.col("text"), n_words(F.col("text"))).alias("tokens"))


def fitted(sample: DataFrame, features: int) -> tuple[list[float], DataFrame]:
    """The domains' log-probabilities without any token, and (token, weights): what each token adds to them."""
    k = range(len(DOMAINS))
    counts = dict(sample.groupBy("domain").count().collect())
    n = [counts.get(i, 0) for i in k]
    total = sum(n)
    on = [F.count_if(F.col("domain") == i).alias(f"n{i}") for i in k]
    seen = sample.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *on)
    seen = seen.where(F.col("n") >= LEAST_TEXTS)

    def part(count: Column, margin: Column, i: int) -> Column:
        """One cell of the likelihood ratio of token and domain."""
        return F.when(count > 0, count * F.log(count * total / (margin * max(n[i], 1)))).otherwise(0.0)

    ratio = sum((part(F.col(f"n{i}"), F.col("n"), i) + part(n[i] - F.col(f"n{i}"), total - F.col("n"), i) for i in k), F.lit(0.0))
    lift = F.greatest(*[F.col(f"n{i}") * total / (F.col("n") * max(n[i], 1)) for i in k])
    chance = [(F.col(f"n{i}") + 0.5) / (n[i] + 1.0) for i in k]
    model = seen.select(
        "token", F.array(*[F.log(c / (1 - c)) for c in chance]).alias("weights"),
        F.array(*[F.log(1 - c) for c in chance]).alias("without"), ratio.alias("ratio"), lift.alias("lift"))
    model = model.where((F.col("ratio") >= LEAST_RATIO) & (F.col("lift") >= LIFT))
    model = materialized(model.orderBy(F.desc("ratio"), "token").limit(features).drop("ratio", "lift"), "model")
    without = model.agg(*[F.sum(F.get("without", F.lit(i))) for i in k]).first()
    return [math.log((n[i] + 1.0) / (total + len(n))) + (without[i] or 0.0) for i in k], model.drop("without")


def members(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """One row per distinct text: ``of`` (digest), ``n_rows``, ``n_words`` and ``p`` (posterior)."""
    k = len(DOMAINS)
    chosen = materialized(labelled_sample(docs, labels, sample), "sample")
    start, model = fitted(chosen, features)
    text = F.coalesce(F.col("text"), F.lit(""))
    # In two steps, so that digest and words are computed once per text and not once per token.
    read = docs.select(text.alias("text"), n_words(text).alias("n_words"))
    read = read.select(F.md5("text").alias("of"), "n_words", tokens(F.col("text"), F.col("n_words")).alias("tokens"))
    spread = read.select("of", "n_words", F.posexplode_outer("tokens").alias("at", "token"))
    found = spread.join(F.broadcast(model), "token", "left")  # at most ``features`` rows
    sums = found.groupBy("of").agg(
        F.any_value("n_words").alias("n_words"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("n_rows"),
        *[F.sum(F.get("weights", F.lit(i))).alias(f"w{i}") for i in range(k)])
    # Equal texts added up n_rows times.
    scores = F.array(*[start[i] + F.coalesce(f"w{i}", F.lit(0.0)) / F.col("n_rows") for i in range(k)])
    known = not chosen.isEmpty()
    odds = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")) if known else F.lit(1.0))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return (sums.withColumn("scores", scores).withColumn("odds", odds)
            .select("of", "n_rows", "n_words", F.transform("odds", lambda x: x / total).alias("p")))


def cell(p: Column) -> Column:
    """Where a posterior lies on the grid, and whether its texts always stay."""
    marks = [F.floor(F.get(p, F.lit(i)) * GRID).cast("string") for i in range(len(DOMAINS))]
    return F.concat_ws("/", *marks, (F.get(p, F.lit(DOMAINS.index(REFERENCE))) >= STAYS).cast("string"))


def cells(rows: DataFrame) -> DataFrame:
    """``rows`` (n_rows, n_words, p) by cell: ``cell``, ``n_rows`` 1, ``n_words`` and the mean ``p`` of its words."""
    words = F.col("n_words") * F.col("n_rows")
    sums = rows.groupBy(cell(F.col("p")).alias("cell")).agg(
        F.sum(words).alias("n_words"), *[F.sum(words * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(len(DOMAINS))],
        F.any_value("p").alias("one"))
    # Without words any of its posteriors will do: the rate of such a cell counts for nothing.
    mean = F.array(*[F.col(f"s{i}") / F.col("n_words") for i in range(len(DOMAINS))])
    return sums.select("cell", F.lit(1).alias("n_rows"), "n_words", F.when(F.col("n_words") > 0, mean).otherwise(F.col("one")).alias("p"))


def fit_rates(rows: DataFrame, weights: dict[str, float], steps: int = STEPS,
              least: Column | None = None) -> tuple[DataFrame, list[float], list[float], float]:
    """``rows`` (n_rows, n_words, p) with ``rate``, the words targeted and the words reached, by domain, and the share of
    all words that a further step would move. No rate is below ``least``."""
    k = range(len(DOMAINS))
    words = F.col("n_words") * F.col("n_rows")
    floor = F.lit(0.0) if least is None else least

    def part(by: Column, i: int) -> Column:
        return F.coalesce(F.sum(words * by * F.get("p", F.lit(i))), F.lit(0.0)).alias(f"e{i}")

    have = [float(x) for x in rows.agg(*[part(F.lit(1.0), i) for i in k]).first()]
    everything = max(sum(have), 1.0)
    target = [weights[d] / weights[REFERENCE] * have[DOMAINS.index(REFERENCE)] for d in DOMAINS]

    def against(reached: list[float]) -> Column:
        """What a step subtracts from a rate: one number per domain is all that it takes from the cluster."""
        slope = [(reached[i] - target[i]) / have[i] if have[i] > 0 else 0.0 for i in k]
        return sum((F.get("p", F.lit(i)) * slope[i] for i in k), F.lit(0.0))

    def squares(reached: list[float]) -> float:
        return sum((reached[i] - target[i]) ** 2 / have[i] for i in k if have[i] > 0)

    fitted_rows = rows.withColumns({"rate": F.lit(1.0), "before": F.lit(1.0)})
    now = before = have
    momentum, off = 1.0, math.inf
    for step in range(1, steps + 1):
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        carry = (momentum - 1) / following
        ahead = [now[i] + carry * (now[i] - before[i]) for i in k]
        plain = F.abs(F.col("rate") - F.greatest(F.col("rate") - against(now), floor))
        moved = F.greatest(F.col("rate") + carry * (F.col("rate") - F.col("before")) - against(ahead), floor)
        stepped = fitted_rows.withColumns({"rate": moved, "before": F.col("rate"), "plain": plain})
        *reached, left = stepped.agg(*[part(F.col("rate"), i) for i in k], F.coalesce(F.sum(words * F.col("plain")), F.lit(0.0))).first()
        off = left / everything
        if off <= TOLERANCE:
            break
        fitted_rows, before, now = stepped.drop("plain"), now, [float(x) for x in reached]
        momentum = following
        if squares(now) > squares(before):
            momentum, before = 1.0, now
            fitted_rows = fitted_rows.withColumn("before", F.col("rate"))
        if step % STORE_EVERY == 0:
            fitted_rows = materialized(fitted_rows, "rates")
    return fitted_rows.drop("before"), target, now, off


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None,
          sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """``docs`` with ``n_words``, ``p_<domain>`` for each domain and ``rate``; columns of these names are replaced."""
    added = ["n_words", *(f"p_{d}" for d in DOMAINS), "rate"]
    kept = [c for c in docs.columns if c not in added]
    keyed = docs.select(*[docs[f"`{c}`"] for c in kept], F.md5(F.coalesce(docs["text"], F.lit(""))).alias("__of__"))
    joined = keyed.join(rated_texts(docs, labels, weights, sample, features), keyed["__of__"] == F.col("__text__"))
    return joined.select(*[keyed[f"`{c}`"] for c in kept], F.col("__words__").alias("n_words"),
                         *[F.get("__p__", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.col("__rate__").alias("rate"))


def rated_texts(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None,
                sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """(__text__, __words__, __p__, __rate__) for every distinct text, by its digest."""
    base = materialized(members(docs.select("doc_id", "text"), labels, sample, features), "members")
    stays = (F.get("p", F.lit(DOMAINS.index(REFERENCE))) >= STAYS).cast("double")
    fitted_rows, _, _, _ = fit_rates(base, weights or WEIGHTS, least=stays)
    return materialized(fitted_rows.select(
        F.col("of").alias("__text__"), F.col("n_words").alias("__words__"), F.col("p").alias("__p__"), F.col("rate").alias("__rate__")), "rates")


def copies(rate: Column, *key: Column | str) -> Column:
    """Whole copies whose expectation is the rate, by a hash of ``key`` that no other choice is made by."""
    part = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + part)


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every row as often as its rate says, in the columns and with the values of ``docs``."""
    of = F.md5(F.coalesce(docs["text"], F.lit("")))
    keyed = docs.select(*[docs[f"`{c}`"].alias(f"__{i}__") for i, c in enumerate(docs.columns)], of.alias("__of__"), docs["doc_id"].alias("__id__"))
    joined = keyed.join(rated_texts(docs, labels, weights), F.col("__of__") == F.col("__text__"))
    number = copies(F.col("__rate__"), "__id__", "__of__").cast("int")
    repeated = joined.withColumn("__copy__", F.explode(F.array_repeat(F.lit(1), number)))
    return repeated.select(*[F.col(f"__{i}__").alias(c) for i, c in enumerate(docs.columns)])
