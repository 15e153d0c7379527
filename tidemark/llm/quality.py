"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Every text gives a vector of transformed statistics. Per language and source, the location and covariance of
the vectors are estimated by minimum covariance determinant: from a coordinatewise start, concentration steps
keep the share ``CORE`` of documents that are nearest in Mahalanobis distance and estimate anew from these,
which never raises the determinant. Documents beyond the cut-off of the chi-squared distribution go.

Clean text has some statistics that are zero throughout, whose variance would be zero; a tolerance per
statistic is added to the diagonal, the deviation that is no cause for suspicion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import text_key
from tidemark.plans.scratch import cut

#: White space inside words' surroundings, and the characters counted as symbols.
BLANKS = ("\t", "\n", "\x0b", "\f", "\r")
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Share of a group that the estimates rest on, in concentration steps.
CORE, STEPS = 0.75, 4
#: 0.75 / P(chi2 with 6 degrees < the 0.75 quantile with 4): makes the core's covariance that of all, were they normal.
CONSISTENCY = 1.486
#: The chi-squared quantile with 4 degrees of freedom that one clean document in a million exceeds.
CUTOFF = 33.38
#: Statistics and their tolerances (standard deviations).
TOLERANCE = {"x_length": 0.1, "x_symbols": 0.25, "x_lines": 0.25, "x_repeats": 0.25}


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Words are cut at white space; a line counts if it has a word; a repeated word stands in a window of three
    words that is found twice or more in the text. Null texts have no words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = text
    for blank in BLANKS:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    lines = F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" " + "".join(BLANKS))) != "")
    rest = [c for c in docs.columns if c != "text"]
    step = docs.select(
        F.struct(*rest).alias("_row") if rest else F.struct(F.lit(0)).alias("_row"),
        F.array_remove(F.split(spaced, " "), "").alias("_words"),
        lines.alias("_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("_symbols"),
    )
    windows = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
    )
    step = step.select(
        "_row",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.col("_symbols").cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(windows).alias("_windows"),
    )
    twice = F.filter("_windows", lambda w, k: (F.get("_windows", k - 1)["h"] == w["h"]) | (F.get("_windows", k + 1)["h"] == w["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))
    keep = [F.col("_row")[c].alias(c) for c in rest]
    return step.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """The vector: log word length, symbols per character on a scale that is linear near zero, and two shares."""
    return {
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbols": F.asinh(50 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x_repeats": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    }


def _factor(groups: DataFrame, names: list[str]) -> DataFrame:
    """Cholesky factor ``l_<i>_<j>`` of the scaled covariance plus tolerances, from ``v_<i>_<j>``."""
    n = len(names)
    for j in range(n):
        for i in range(j, n):
            value = F.col(f"v_{i}_{j}") * CONSISTENCY + (F.lit(TOLERANCE[names[i]] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    return groups


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution; the factor's columns stand beside the vector."""
    solved: list[Column] = []
    for i, name in enumerate(names):
        value = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * solved[k]
        solved.append(value / F.col(f"l_{i}_{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(g, rows["lang"].eqNullSafe(g["_lang"]) & rows["source"].eqNullSafe(g["_source"])).drop("_lang", "_source")


def robust_estimates(vectors: DataFrame, names: list[str], core: float = CORE, steps: int = STEPS) -> DataFrame:
    """Per ``lang, source``: means ``m_<i>`` and Cholesky factor ``l_<i>_<j>`` of the robust covariance."""
    n = len(names)
    middle = vectors.groupBy("lang", "source").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m_{i}") for i, x in enumerate(names)])
    groups = middle.withColumns({f"v_{i}_{j}": F.lit(0.0) for i in range(n) for j in range(i + 1)})
    moments = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)]
    moments += [F.covar_pop(names[i], names[j]).alias(f"v_{i}_{j}") for i in range(n) for j in range(i + 1)]
    for _ in range(steps):
        placed = _with_group(vectors, cut(_factor(groups, names), "estimates")).select("lang", "source", *names, _distance(names).alias("_d"))
        near = cut(placed.groupBy("lang", "source").agg(F.percentile_approx("_d", core, 10_000).alias("_limit")), "limits")
        groups = _with_group(placed, near).where(F.col("_d") <= F.col("_limit")).groupBy("lang", "source").agg(*moments)
    return cut(_factor(groups, names), "estimates")


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Verdict on every row: ``doc_id, text_key, lang, source``, the statistics, ``base_failed, distance, kept``.

    A row is kept if it has at least 50 words, at most half of them repeated, and a vector whose squared
    Mahalanobis distance in its language and source is no more than the cut-off. Null languages and sources
    are groups of their own. Documents that fail the base rules have no part in the estimates and a null
    distance. Null and empty texts fail; repeated rows are judged alike; other columns are left aside.
    """
    names = list(TOLERANCE)
    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "lang", "source", "text")
    seen = cut(statistics(narrow).withColumn("base_failed", base_failed()).withColumns(transformed()), "statistics")
    groups = robust_estimates(seen.where(~F.col("base_failed")).select("lang", "source", *names), names)
    passed = _with_group(seen.where(~F.col("base_failed")), groups).select(*seen.columns, _distance(names).alias("distance"))
    failed = seen.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return passed.union(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False))).drop(*names)
