"""Sampling documents so that sources, languages and topics have given shares of the tokens.

Iterative proportional fitting: the table of tokens by source, language and topic is scaled to each of three marginals in
turn until all hold.  The scaled table is always ``tokens * a[source] * b[language] * c[topic]``.  A cycle sums the table
over sources in Spark, where sources may be very many, and settles languages and topics, a small
table, on the driver.  Documents are then sampled with probabilities in proportion to ``a b c``, the largest being 1.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.sources.tables import stored

NONE = "(none)"
SMALL_CELLS = 1_000_000  # languages x topics that the driver may hold


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of a text: legal, tabular, numeric, prose; null text is prose."""
    text = F.coalesce(text, F.lit(""))
    digits = F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))
    return (
        F.when(text.contains("License") | text.contains("Licensed"), "legal")
        .when(text.contains(" | "), "tabular")
        .when(digits >= 20, "numeric")
        .otherwise("prose")
    )


def words_in(text: Column) -> Column:
    """Number of words (runs of other than ASCII white space), at least 1 so that every document has weight."""
    return F.greatest(F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+", " ")), " ")), F.lit(1)).cast("long")


def flattened(tokens: Mapping[str, float], power: float = 0.8) -> dict[str, float]:
    """Target shares between the present ones (power 1) and equal ones (power 0)."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised[k] for k in sorted(raised))
    return {k: v / total for k, v in raised.items()}


def raked(cells: DataFrame, power: float = 0.8, rounds: int = 100, tolerance: float = 1e-9) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """Factors of sources (``source``, ``factor``) and of (language, topic).  ``cells``: source, language, topic, tokens.

    The targets of each marginal are its present shares raised to ``power``.  A cycle fits sources, then languages, then topics;
    cycles end when languages and topics are within ``tolerance`` of their targets once sources are, or after ``rounds`` cycles.
    """
    spark = cells.sparkSession
    by_pair = {(r.language, r.topic): float(r.tokens) for r in cells.groupBy("language", "topic").agg(F.sum("tokens").alias("tokens")).limit(SMALL_CELLS + 1).collect()}
    if len(by_pair) > SMALL_CELLS:
        raise ValueError("languages and topics are meant to be small sets: merge rare ones first")
    languages, topics = {}, {}
    for (language, topic), n in sorted(by_pair.items()):
        languages[language] = languages.get(language, 0.0) + n
        topics[topic] = topics.get(topic, 0.0) + n
    language_goal, topic_goal = flattened(languages, power), flattened(topics, power)
    pairs = sorted(by_pair)
    numbered = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "language string, topic string, pair int")
    placed = cells.join(F.broadcast(numbered), ["language", "topic"])
    # at most languages x topics entries a source
    by_source = placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.collect_list(F.struct("pair", "tokens")).alias("cells"))
    scale = by_source.agg(F.sum(F.pow("tokens", F.lit(power))).alias("total"))
    goals = stored(by_source.join(F.broadcast(scale)).select("source", "cells", (F.pow("tokens", F.lit(power)) / F.col("total")).alias("goal")), "sources")
    factor = {pair: 1.0 for pair in by_pair}
    for _ in range(rounds):
        used = factor
        # one constant: a small table sent anew in every cycle would pile up on the driver
        table = F.split(F.lit(",".join(repr(used[pair]) for pair in pairs)), ",").cast("array<double>")
        weighed = goals.select("source", "goal", F.transform("cells", lambda c: F.struct(c["pair"].alias("pair"), (c["tokens"] * F.get(table, c["pair"])).alias("w"))).alias("cells"))
        fitted = weighed.select("source", (F.col("goal") / F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["w"])).alias("a"), "cells")
        sums = fitted.select("a", F.explode("cells").alias("c")).groupBy("c.pair").agg(F.sum(F.col("a") * F.col("c.w")).alias("w"))
        before = {pairs[r.pair]: r.w for r in sums.collect()}
        now = before
        for goal, side in ((language_goal, 0), (topic_goal, 1)):
            total: dict[str, float] = {}
            for pair in sorted(now):
                total[pair[side]] = total.get(pair[side], 0.0) + now[pair]
            now = {pair: w * goal[pair[side]] / total[pair[side]] for pair, w in now.items()}
        if max(abs(now[p] / before[p] - 1) for p in now) <= tolerance:
            break
        factor = {pair: f * now[pair] / before[pair] for pair, f in used.items()}
    return fitted.select("source", F.col("a").alias("factor")), used


def calibrated(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None, power: float = 0.8) -> DataFrame:
    """All columns of ``docs`` with ``topic``, ``tokens`` and ``probability`` (above 0 to 1), calibrated to the three marginals.

    ``docs`` has ``text``, ``lang`` and ``source``; a null language or source is a group of its own.  With these probabilities the expected
    tokens of each source, language and topic have their target shares.  An empty table gives no row.  Columns of the three new
    names are replaced.
    """
    docs = docs.drop("topic", "tokens", "probability")
    marked = docs.withColumns({"topic": topic_of(F.col("text")) if topic is None else topic, "tokens": words_in(F.col("text")) if tokens is None else tokens})
    slim = marked.select(F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("language"), "topic", "tokens")
    cells = stored(slim.groupBy("source", "language", "topic").agg(F.sum("tokens").cast("double").alias("tokens")), "cells")
    if cells.isEmpty():
        return marked.withColumn("probability", F.lit(1.0))
    sources, factor = raked(cells, power)
    sources = stored(sources, "factors")
    spark = docs.sparkSession
    pairs = spark.createDataFrame([(a, b, f) for (a, b), f in sorted(factor.items())], "_language string, topic string, _pair double")
    known = cells.join(sources, "source").join(F.broadcast(pairs.withColumnRenamed("_language", "language")), ["language", "topic"])
    top = known.agg(F.max(F.col("factor") * F.col("_pair")).alias("top")).first().top
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # one column: no name can clash
    rates = sources.select(F.col("source").alias("_source"), F.col("factor").alias("_factor"))
    keyed = marked.select(whole.alias("_whole"), "topic", "tokens", F.coalesce("source", F.lit(NONE)).alias("_source"), F.coalesce("lang", F.lit(NONE)).alias("_language"))
    rated = keyed.join(rates, "_source").join(F.broadcast(pairs), ["_language", "topic"])
    chance = F.least(F.lit(1.0), F.col("_factor") * F.col("_pair") / F.lit(top))
    return rated.withColumn("probability", chance).select(*[F.col(f"_whole.`{c}`").alias(c) for c in docs.columns], "topic", "tokens", "probability")


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from a hash of the key: the same on every run and in every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of :func:`calibrated` that are drawn: each with its probability, by a hash of ``doc_id``.  Rows with one id are drawn together."""
    rated = calibrated(docs, **options)
    return rated.where(uniform(F.col("doc_id")) < F.col("probability"))
