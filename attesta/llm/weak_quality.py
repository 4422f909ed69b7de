"""Document quality by weak supervision: rules vote or abstain, EM learns how far each can be trusted.

Only DataFrame functions are used. Votes are reduced to counts of distinct vote patterns (3^rules rows at most,
whatever the corpus), the EM steps aggregate that table, and the posterior is an expression of the votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.store import kept

SEPARATOR = r"[\x20\x09-\x0D]+"
RULES = ("length", "symbols", "lines", "repeats", "word_size", "capitals", "letters", "sentences")


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_letters, n_stops).

    Each step is its own projection, used more than once by the next, so arrays are built once a row. A null text
    counts as empty. Windows of five words are compared by their 64-bit hash within one text.
    """
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", SEPARATOR), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"[.!?](?=\s|$)")).cast("long").alias("n_stops"),
        F.when(
            F.size("words") >= 5,
            F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, F.lit(5)))),
        ).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    ordered = windows.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("hashes")
    again = ordered.withColumn(
        "again",
        F.array_sort(
            F.transform(
                F.filter(
                    "placed",
                    lambda x, k: F.coalesce(x.h == F.get("placed", k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("placed", k + 1).h, F.lit(False)),
                ),
                lambda x: x.i,
            )
        ),
    ).drop("placed")
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda s, i: F.struct((s.n + F.least(F.lit(5), i - s.last)).alias("n"), i.alias("last")),
        lambda s: s.n.cast("long"),
    )
    return again.withColumn("n_repeat_words", covered).drop("again")


def votes(measured: DataFrame) -> DataFrame:
    """Adds one column `vote_<rule>` a rule: 1 speaks for the text, -1 against it, 0 abstains."""

    def vote(good: Column, bad: Column) -> Column:
        return F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0))

    n, chars = F.col("n_words"), F.col("word_chars")
    found = {
        "length": vote(n >= 50, n < 10),
        "symbols": vote((n > 0) & (F.col("n_symbols") * 100 <= n), F.col("n_symbols") * 10 > n),
        "lines": vote((F.col("n_dup_lines") == 0) & (n >= 30), F.col("n_dup_lines") >= 3),
        "repeats": vote((F.col("n_repeat_words") * 50 <= n) & (n >= 30), F.col("n_repeat_words") * 5 > n),
        "word_size": vote((chars >= 3 * n) & (chars <= 9 * n) & (n > 0), (chars < 2 * n) | (chars > 14 * n)),
        "capitals": vote((F.col("n_capitals") * 8 <= chars) & (n > 0), F.col("n_capitals") * 3 > chars),
        "letters": vote((F.col("n_letters") * 100 >= chars * 90) & (n > 0), F.col("n_letters") * 100 < chars * 75),
        "sentences": vote((F.col("n_stops") * 50 >= n) & (F.col("n_stops") * 3 <= n), (F.col("n_stops") == 0) & (n >= 20)),
    }
    return measured.withColumns({f"vote_{k}": v.cast("int") for k, v in found.items()})


@dataclass
class LabelModel:
    """Prior of a good text, and for each rule how often its vote is right on good and on bad texts."""

    prior: float
    good: list[float]
    bad: list[float]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, g, b in zip(RULES, self.good, self.bad):
            v = F.col(f"vote_{rule}")
            total = total + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
        return total

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def fit(voted: DataFrame, rounds: int = 60, close: float = 1e-3) -> LabelModel:
    """EM for the accuracies, from 0.8 and an even prior, until no parameter moves by `close`.

    Counts are smoothed by one vote on each side, so an empty table gives the starting values' mean of a half.
    """
    names = [f"vote_{r}" for r in RULES]
    patterns = kept(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "votes")
    model = LabelModel(0.5, [0.8] * len(RULES), [0.8] * len(RULES))
    for _ in range(rounds):
        sums = [F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad")]
        for r, v in zip(RULES, names):
            sums += [
                F.sum(F.when(F.col(v) == sign, F.col("n") * weight)).alias(f"{r}_{name}_{side}")
                for side, sign in (("up", 1), ("down", -1))
                for name, weight in (("good", F.col("p")), ("bad", 1 - F.col("p")))
            ]
        s = {k: v or 0.0 for k, v in patterns.withColumn("p", model.posterior()).agg(*sums).first().asDict().items()}
        share = lambda a, b: min(max((a + 1) / (a + b + 2), 1e-3), 1 - 1e-3)
        new = LabelModel(
            share(s["good"], s["bad"]),
            [share(s[f"{r}_good_up"], s[f"{r}_good_down"]) for r in RULES],
            [share(s[f"{r}_bad_down"], s[f"{r}_bad_up"]) for r in RULES],
        )
        moved = max(abs(a - b) for a, b in zip([new.prior, *new.good, *new.bad], [model.prior, *model.good, *model.bad]))
        model = new
        if moved < close:
            break
    return model


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior) of every row.

    A row is kept if it does not fail the base rule and its posterior probability of being good is at least `least`.
    Null and empty texts have no words and fail; null ids and repeated rows are judged like any other row.
    """
    voted = kept(votes(measures(docs)), "quality")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    posterior = fit(voted).posterior()
    return voted.select(
        "doc_id", *counts, failed.alias("base_failed"), (~failed & (posterior >= least)).alias("kept"), posterior.alias("posterior")
    )
