"""Quality rules as a short-circuit cascade (DataFrame functions only).

Features of a text are column expressions; a rule is a named predicate that
rejects.  ``cascade_order`` measures every rule's cost and selectivity on a
bounded sample and orders the rules by rejection per cost; ``cascade`` chains
them in one CASE expression, so that a rule is evaluated only for rows that all
earlier rules let pass.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.common import WHITE, WHITE_RE, free_name, saved

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RE))


def with_base_counts(df: DataFrame, text: str = "text", words: str = "_words") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the word array.

    A null text counts as empty: all counts are 0.  A 3-word window is compared by
    a 64-bit hash of its words; hashes are sorted together with their positions,
    so a text of n words costs n log n, whatever it repeats.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines, windows, starts = (free_name(df, x) for x in ("_q_lines", "_q_windows", "_q_starts"))
    out = df.withColumn(words, words_of(F.col(text))).withColumn(
        lines, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    w = F.col(words)
    out = out.withColumn(windows, F.when(F.size(w) >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))))
    win = F.col(windows)
    same = lambda x, k: F.coalesce(x["h"] == F.get(win, k)["h"], F.lit(False))
    out = out.withColumn(starts, F.sort_array(F.transform(
        F.filter(win, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.col(starts), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"])
    # Always true, but not deterministic: a filter on the counts stays above this projection and
    # does not copy the array expressions into itself once for every element.
    here = F.monotonically_increasing_id() >= 0
    return (out
            .withColumn("n_words", F.size(w).cast("long"))
            .withColumn("word_chars", F.char_length(F.translate(t, WHITE, "")).cast("long"))
            .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
            .withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_repeat_words", F.when(here, F.coalesce(covered, F.lit(0)).cast("long")))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
            .drop(lines, windows, starts))


def default_rules(text: str = "text") -> dict[str, Column]:
    """The method's own rules, each true where a text is rejected.

    symbols: more than one symbol character per two words; dup_lines: over half of
    the lines repeat an earlier one; word_length: mean word shorter than 2 or longer
    than 20 code points; digits: over half of the word characters are digits;
    long_word: one word holds over half of a text of at least 50 words' characters.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    digits = F.char_length(t) - F.char_length(F.translate(t, DIGITS, ""))
    longest = F.array_max(F.transform(F.col("_words"), F.char_length))
    return {
        "symbols": 2 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "digits": 2 * digits > F.col("word_chars"),
        "long_word": F.coalesce(2 * longest > F.col("word_chars"), F.lit(False)),
    }


def cascade_order(df: DataFrame, rules: dict[str, Column], sample_rows: int = 2000,
                  seed: int = 7) -> list[dict]:
    """Rules with measured selectivity and seconds, best rejection per cost first.

    The sample (about ``sample_rows`` rows drawn over the whole table; a documented
    bound) only orders the rules.  A rule's cost is the time of its own scan of the
    saved sample less that of a scan without a rule.
    """
    n = df.count()
    if not n:
        return [{"rule": k, "rejects": 0.0, "cost_s": 0.0} for k in rules]
    sample = saved(df.sample(fraction=min(1.0, sample_rows / n), seed=seed))

    def timed(pred: Column) -> tuple[int, float]:
        began = time.perf_counter()
        hit = sample.agg(F.count_if(pred), F.count(F.lit(1))).first()
        return hit[0], hit[1], time.perf_counter() - began

    timed(F.lit(False))
    *_, idle = timed(F.lit(False))
    found = []
    for name, pred in rules.items():
        hits, rows, took = timed(pred)
        found.append({"rule": name, "rejects": hits / max(rows, 1), "cost_s": max(took - idle, 1e-3)})
    return sorted(found, key=lambda r: (-r["rejects"] / r["cost_s"], r["cost_s"], r["rule"]))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, in this order; null if none does."""
    chain = None
    for name in order:
        hit = F.coalesce(rules[name], F.lit(False))
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain if chain is not None else F.lit(None).cast("string")


def quality_verdict(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the base counts, base_failed and kept.

    kept: neither the base nor any rule of the cascade rejects.  Defined results:
    null, empty or blank texts have no words and fail the base; repeated rows each
    get their own verdict; an empty table gives an empty result.  Columns of the
    input named like a result column are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "kept"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    rules = default_rules(text)
    plain = docs.select(F.col(text))
    words = free_name(docs, "_words")
    if words != "_words":
        docs = docs.withColumnRenamed("_words", words)
    n = plain.count()
    sample = plain.sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=7)
    order = [r["rule"] for r in cascade_order(saved(with_base_counts(sample, text)), rules, sample_rows)]
    out = with_base_counts(docs, text).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules, order).isNull())).drop("_words")
    return out.withColumnRenamed(words, "_words") if words != "_words" else out
