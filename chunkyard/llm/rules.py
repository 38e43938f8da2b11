"""Quality rules with weak supervision, in SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0) on statistics of a text.  Documents with equal votes
are counted together, which leaves at most 3 ** (number of rules) vote patterns whatever the corpus.
Expectation-maximisation over the counted patterns estimates, for good and for bad documents, how often
each rule votes what; it runs inside one SQL expression over the one row of patterns.  A pattern's
posterior probability of quality, joined back by pattern, replaces all-must-pass filtering.

Words are runs without space, tab, line feed, vertical tab, form feed and return.  Repeated windows are
found by the 64-bit hashes of a text's three-word windows.

Edge cases: null text has no words; a text without words fails the base; an empty table gives no rows;
repeated rows count each; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import stage

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_POSTERIOR = 0.5
EM_ROUNDS = 40
#: Added to each count of votes, so that no probability is zero.
PRIOR_VOTES = 1.0

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "le", "la", "les", "de", "et", "des", "un", "une", "que", "der", "die", "das", "und", "zu", "ist", "mit", "el", "los", "las", "y", "en", "por", "con", "se"]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(words: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more in the text."""
    windows = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    )

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, places))

    return let(windows, covered)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the base and the rules are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, SPACE, -1), "").alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\x20\x09-\x0D]")).cast("long").alias("n_not_letters"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"!!")).cast("long").alias("n_shouts"),
        F.size(F.array_intersect(F.transform("words", lambda w: F.lower(w)), F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"'»…][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules; each is a threshold pair over the statistics, with abstention between."""
    c = F.col
    per_word = lambda name: c(name) / F.greatest(c("n_words"), F.lit(1))
    per_line = lambda name: c(name) / F.greatest(c("n_lines"), F.lit(1))
    return {
        "length": vote(c("n_words") < 20, c("n_words") >= LEAST_WORDS),
        "word_length": vote((per_word("word_chars") < 2) | (per_word("word_chars") > 14), per_word("word_chars").between(3, 10)),
        "symbols": vote(per_word("n_symbols") > 0.3, per_word("n_symbols") < 0.1),
        "symbol_runs": vote(per_word("n_symbol_runs") > 0.2, per_word("n_symbol_runs") < 0.05),
        "letters": vote(c("n_not_letters") > 0.25 * c("word_chars"), c("n_not_letters") < 0.12 * c("word_chars")),
        "dup_lines": vote(per_line("n_dup_lines") > 0.3, per_line("n_dup_lines") < 0.1),
        "repetition": vote(per_word("n_repeat_words") > 0.4, per_word("n_repeat_words") < 0.2),
        "capitals": vote(c("n_upper") > 0.4 * c("word_chars"), c("n_upper") < 0.2 * c("word_chars")),
        "shouting": vote(per_word("n_shouts") > 0.1, per_word("n_shouts") < 0.02),
        "function_words": vote(c("n_function_words") == 0, c("n_function_words") >= 3),
        "ended_lines": vote(per_line("n_ended_lines") < 0.1, per_line("n_ended_lines") > 0.5),
    }


_STATE = "struct<good_share:double,good:array<array<double>>,bad:array<array<double>>>"


def _posterior(state: Column, pattern: Column) -> Column:
    """P(good | votes); rules vote independently of each other given the class."""
    odds = F.aggregate(
        F.transform(pattern, lambda v, j: F.log(F.get(F.get(state["good"], j), v + 1) / F.get(F.get(state["bad"], j), v + 1))),
        F.log(state["good_share"] / (1 - state["good_share"])),
        lambda a, x: a + x,
    )
    return 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -odds))))


def estimate(patterns: DataFrame, n_rules: int, rounds: int = EM_ROUNDS) -> DataFrame:
    """From votes and n, the number of documents with those votes: votes and the posterior of each pattern."""
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p")).where(F.size("p") > 0)
    # Start: rules are usually right; bad documents are the rarer and each rule sees only some of them.
    good, bad = F.array(F.lit(0.02), F.lit(0.1), F.lit(0.88)), F.array(F.lit(0.3), F.lit(0.2), F.lit(0.5))
    start = F.struct(F.lit(0.8).alias("good_share"), F.array(*[good] * n_rules).alias("good"), F.array(*[bad] * n_rules).alias("bad")).cast(_STATE)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def rates(p: Column, weights: Column, mass: Column) -> Column:
        """For each rule, how often it votes bad, abstains, votes good among documents of these weights."""
        hit = lambda j, v: total(F.zip_with(p, weights, lambda r, w: F.when(F.get(r["votes"], j) == v, w).otherwise(0.0)))
        return F.transform(
            F.sequence(F.lit(0), F.lit(n_rules - 1)),
            lambda j: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda v: (hit(j, v) + PRIOR_VOTES) / (mass + 3 * PRIOR_VOTES)),
        )

    def step(state: Column, _: Column) -> Column:
        def update(w: Column) -> Column:
            mass = F.struct(total(w["good"]).alias("good"), total(w["bad"]).alias("bad"))
            return let(
                mass,
                lambda m: F.struct(
                    ((m["good"] + PRIOR_VOTES) / (m["good"] + m["bad"] + 2 * PRIOR_VOTES)).alias("good_share"),
                    rates(F.col("p"), w["good"], m["good"]).alias("good"),
                    rates(F.col("p"), w["bad"], m["bad"]).alias("bad"),
                ),
            )

        shares = F.transform("p", lambda r: _posterior(state, r["votes"]))
        weights = let(shares, lambda s: F.struct(F.zip_with("p", s, lambda r, g: r["n"] * g).alias("good"), F.zip_with("p", s, lambda r, g: r["n"] * (1 - g)).alias("bad")))
        return let(weights, update).cast(_STATE)

    fitted = one.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("state"))
    judged = fitted.select(F.explode(let(F.col("state"), lambda s: F.transform("p", lambda r: F.struct(r["votes"].alias("votes"), _posterior(s, r["votes"]).alias("posterior"))))).alias("r"))
    return judged.select("r.votes", "r.posterior")


def judge(docs: DataFrame, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """The statistics, base_failed, votes, posterior and kept for every document."""
    rules = votes()
    counted = stage(statistics(docs).withColumn("votes", F.array(*rules.values())), "rule-votes")
    patterns = counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    posterior = estimate(patterns, len(rules))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    # At most 3 ** len(rules) rows: far below what any executor can hold.
    both = counted.join(F.broadcast(posterior), "votes", "left").withColumn("base_failed", base)
    return both.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= least_posterior))
