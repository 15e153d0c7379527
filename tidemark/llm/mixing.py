"""Mixing of sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are) and
normalised. The exponent is found by bisection, as the flattest that keeps the repetition of every source
within a limit, or as the one whose weights have a wanted entropy. The weights are realised in passes: a
source whose budget is 2.4 times its tokens gives two seeded permutations of all its documents and of a third
one as many documents from its start as the budget holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ranks import running, shuffle_number
from tidemark.llm.text import with_texts, word_count
from tidemark.plans.scratch import cut

REPEAT_LIMIT, SEED = 2.0, 42
#: Exponents looked at in one pass over the totals (five halvings), and passes.
POINTS, ROUNDS = 31, 9


#: Columns of the manifest that replace those of the documents.
_NEW = ("text", "text_md5", "n_tokens", "block", "place")


def token_totals(rows: DataFrame) -> DataFrame:
    """``_source, total`` from ``_source, tokens``; sources without tokens are left out."""
    return rows.groupBy("_source").agg(F.sum("tokens").alias("total")).where("total > 0")


def find_exponent(totals: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, entropy: float | None = None, budget: int | None = None) -> float:
    """The least exponent in [0, 1] with no source repeated more than the limit, or the greatest with the entropy.

    Entropy is in nats. Without a budget the least repeated source has one pass. Where no exponent does, the
    nearest end of the range is given. The totals stay distributed; a round brings ``POINTS`` numbers back.
    """
    low, high = 0.0, 1.0
    log_total = F.log(F.col("total").cast("double"))

    def values(points: list[float]) -> list[bool]:
        sums = []
        for i, a in enumerate(points):
            power = F.exp(a * log_total)
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * a * log_total).alias(f"e{i}"), F.max(F.exp((a - 1) * log_total)).alias(f"r{i}"), F.min(F.exp((a - 1) * log_total)).alias(f"s{i}")]
        row = totals.agg(*sums).first()
        if row["z0"] is None:
            return [True] * len(points)
        out = []
        for i in range(len(points)):
            if entropy is not None:
                out.append(math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"] <= entropy)
            else:
                most = budget * row[f"r{i}"] / row[f"z{i}"] if budget else row[f"r{i}"] / row[f"s{i}"]
                out.append(most <= repeat_limit)
        return out

    if values([0.0])[0]:
        return 0.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        met = values(points)
        first = met.index(True) if True in met else POINTS
        low, high = points[first - 1] if first else low, points[first] if first < POINTS else high
    return high


def mix(docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, entropy: float | None = None, budget: int | None = None, seed: int = SEED, tokens=None) -> DataFrame:
    """Manifest of the mixture: the columns of ``docs`` but ``text``, ``text_md5, n_tokens, block, place``; one row per use.

    ``block`` counts the passes over a source from 0, ``place`` the rows of a pass in its permutation. Tokens are
    words between white space unless a column expression is given; a text without tokens costs nothing and is
    in every full pass (its source has at least one if it has no tokens at all). Without a budget the
    largest source has one pass, so no document is lost. With one, a source's tokens stay within its weight
    of the budget, short of it by less than the document that follows. Null sources are a source; repeated
    rows are used as rows of their own. Columns named like a new one are replaced.
    """
    kept = _uses(docs, repeat_limit, entropy, budget, seed, tokens)
    rest = [F.col("_row")[c].alias(c) for c in docs.columns if c not in _NEW]
    return kept.select(*rest, F.col("_md5").alias("text_md5"), F.col("tokens").alias("n_tokens"), "block", F.col("rank").alias("place"))


def _uses(docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, entropy: float | None = None, budget: int | None = None, seed: int = SEED, tokens=None) -> DataFrame:
    """``_row`` (the columns of ``docs`` but ``text``), ``_md5, tokens, block, rank`` of every use."""
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"),
        F.to_json(F.struct("source")).alias("_source"),
        F.md5("text").alias("_md5"),
        (word_count(F.col("text")) if tokens is None else tokens.cast("bigint")).alias("tokens"),
    )
    rows = cut(rows, "tokens")
    totals = cut(token_totals(rows), "totals")
    exponent = find_exponent(totals, repeat_limit, entropy, budget)
    share = totals.agg(F.max("total").alias("top"), F.sum(F.exp(exponent * F.log(F.col("total").cast("double")))).alias("z")).first()
    total = F.col("total").cast("double")
    if budget:
        wanted = F.round(budget * F.exp(exponent * F.log(total)) / (share["z"] or 1.0))
    else:
        wanted = F.round(total * F.exp((1 - exponent) * F.log(F.lit(float(share["top"] or 1)) / total)))
    quotas = cut(totals.select("_source", wanted.cast("bigint").alias("quota"), "total").select("_source", F.expr("quota div total").alias("passes"), F.expr("quota % total").alias("left")), "quotas")
    planned = rows.join(quotas, "_source", "left").withColumns({"passes": F.coalesce("passes", F.lit(1)), "left": F.coalesce("left", F.lit(0))})
    last = F.when(F.col("left") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    uses = planned.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    uses = uses.withColumn("_number", shuffle_number(seed, F.col("block"), F.col("_row")["doc_id"], F.coalesce("_md5", F.lit(""))))
    ordered = running(cut(uses, "uses"), ["_source", "block"], "_number", "tokens")
    return ordered.where((F.col("block") < F.col("passes")) | (F.col("upto") <= F.col("left")))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture, each as often as it is used, with the columns of ``docs``; texts move once."""
    manifest = _uses(docs, **how).select("_row", F.col("_row")["doc_id"].alias("doc_id"), "_md5")
    joined = with_texts(manifest, docs, "_md5")
    return joined.select(*[(F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
