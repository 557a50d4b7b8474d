"""Text quality by weak supervision: rules vote or abstain, expectation-maximisation finds out how far to trust each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import write_table
from tidemark.session import scratch_dir

BLANKS = " \t\n\x0b\f\r"
#: Words in a window that counts as repeated.
WINDOW = 8
VOTES = (-1, 0, 1)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per document, each within its row: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_ended_lines, n_distinct_words, n_repeat_words.

    Words are what stands between ASCII blanks; null texts have none. Windows of 8 words are compared by hash: sorting (hash, place) brings equal ones
    together, so the work is n log n in a text's words also if all its windows are the same.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("inner", F.btrim("text", F.lit(BLANKS)))
    words = F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    t = t.select("doc_id", "inner", words.alias("words"), lines.alias("lines"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    t = t.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.length(F.translate("inner", BLANKS, "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(BLANKS + "\"')»”")).rlike(r"[.!?:;…]\z"))).cast("long").alias("n_ended_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashed", i, WINDOW)))
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ended_lines"]
    t = t.select(*kept, F.size(F.array_distinct("hashed")).cast("long").alias("n_distinct_words"), F.when(F.col("n_words") >= WINDOW, windows).alias("windows"))
    kept.append("n_distinct_words")
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    t = t.select(*kept, F.when(again, placed).alias("placed"))
    twin = F.filter("placed", lambda x, i: F.get("placed", i - 1)["h"].eqNullSafe(x["h"]) | F.get("placed", i + 1)["h"].eqNullSafe(x["h"]))
    t = t.select(*kept, F.sort_array(F.transform(twin, lambda x: x["p"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")))
    return t.select(*kept, F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes on the columns of measures(): 1 for good, -1 for bad, 0 if a rule can't tell."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return {
        "length": _vote(n >= 50, n < 20),
        "repeats": _vote((n >= 20) & (100 * F.col("n_repeat_words") <= 10 * n), 100 * F.col("n_repeat_words") > 25 * n),
        "lines": _vote((lines > 0) & (100 * F.col("n_dup_lines") <= 15 * lines), 100 * F.col("n_dup_lines") > 30 * lines),
        "symbols": _vote((n > 0) & (100 * F.col("n_symbols") <= 2 * n), 100 * F.col("n_symbols") > 10 * n),
        "density": _vote((n > 0) & (100 * F.col("n_symbols") <= F.col("word_chars")), 100 * F.col("n_symbols") > 4 * F.col("word_chars")),
        "word_length": _vote((n > 0) & (F.col("word_chars") >= 3 * n) & (F.col("word_chars") <= 7 * n), (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        "endings": _vote((lines > 0) & (100 * F.col("n_ended_lines") >= 60 * lines), (lines > 0) & (F.col("n_ended_lines") == 0)),
        "variety": _vote((n >= 20) & (n <= 2000) & (100 * F.col("n_distinct_words") >= 40 * n), (n >= 20) & (n <= 2000) & (100 * F.col("n_distinct_words") < 20 * n)),
    }


def _odds(names: list[str], prior: float, shares: dict) -> Column:
    """Log odds of good, given the votes. The numbers stand in one array, so that every round runs the same compiled code."""
    table = F.lit([math.log(shares[r, v, 1] / shares[r, v, 0]) for r in names for v in VOTES] + [math.log(prior / (1 - prior))])
    out = F.element_at(table, 3 * len(names) + 1)
    for k, r in enumerate(names):
        out = out + F.element_at(table, (F.col(r) + 3 * k + 2).cast("int"))
    return out


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit(patterns: DataFrame, names: list[str], rounds: int = 30, still: float = 1e-4) -> tuple[float, dict]:
    """The share of good texts and, per rule, vote and class, how often it votes so: expectation-maximisation on vote patterns and their counts `n`.

    A round is one aggregate over the patterns, of which three votes a rule allow 3 ** rules at most, whatever the corpus. A vote never speaks against
    its own direction: where the estimate would turn a rule around, both classes get the same share.
    """
    prior = 0.9
    start = {-1: (0.25, 0.02), 0: (0.25, 0.18), 1: (0.5, 0.8)}
    shares = {(r, v, c): start[v][c] for r in names for v in VOTES for c in (0, 1)}
    for _ in range(rounds):
        p = _sigmoid(_odds(names, prior, shares))
        sums = [F.sum(F.col("n") * p).alias("good"), F.sum("n").alias("all")]
        for r in names:
            for v in VOTES:
                hit = (F.col(r) == v).cast("double") * F.col("n")
                sums += [F.sum(hit * p).alias(f"{r} {v} 1"), F.sum(hit * (1 - p)).alias(f"{r} {v} 0")]
        row = patterns.agg(*sums).first()
        if not row["all"]:
            break
        total = {1: row["good"], 0: row["all"] - row["good"]}
        new = {(r, v, c): (row[f"{r} {v} {c}"] + start[v][c]) / (total[c] + 1) for r in names for v in VOTES for c in (0, 1)}
        for r in names:
            for v, up in ((1, 1), (-1, 0)):
                if new[r, v, up] < new[r, v, 1 - up]:
                    new[r, v, 0] = new[r, v, 1] = (new[r, v, 0] * total[0] + new[r, v, 1] * total[1]) / (total[0] + total[1])
        moved = max(abs(new[k] - shares[k]) for k in new)
        shares, prior = new, min(max(total[1] / row["all"], 0.02), 0.98)
        if moved < still:
            break
    return prior, shares


def assess(spark: SparkSession, docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """measures() of every document, base_failed (fewer than 20 words, or over 30 % of them in repeated windows), p_good and kept.

    All documents that pass the base vote, and their vote patterns alone are fitted; kept means not base_failed and p_good >= `least`. Repeated rows count as often as they
    occur. Null texts and empty ones have no words, so they fail the base. An empty table gives no rows. Other columns are not read.
    """
    folder = scratch_dir(spark, "quality")
    measured = write_table(measures(docs, doc_id, text), f"{folder}/measures")
    votes = rules()
    names = list(votes)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    patterns = write_table(measured.where(~failed).select(*[c.alias(r) for r, c in votes.items()]).groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), f"{folder}/patterns")
    prior, shares = fit(patterns, names)
    judged = measured.withColumns(votes).withColumn("p_good", _sigmoid(_odds(names, prior, shares)))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= least))

