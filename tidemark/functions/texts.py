"""Row-local text expressions; nothing here needs a shuffle."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_col

WORD = r"[\p{L}\p{N}_]+"
# The end mark is optional so that a long tail without one is matched once instead of being
# tried from every position; tails are dropped afterwards.
SENTENCE = r"[^.!?]+[.!?]?"


def squeeze(value: str | Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(as_col(value), r"\s+", " "))


def truncate_words(value: str | Column, limit: int) -> Column:
    """At most ``limit`` characters cut at a blank, with an ellipsis when cut."""
    text = as_col(value)
    head = text.substr(1, limit)
    whole = F.regexp_replace(head, r" [^ ]*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(whole, F.lit("...")))


def count_text(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def padded_words(text: Column) -> Column:
    """Lower-case words with two blanks between and one at each end, so a word or
    phrase can be matched as plain text without regex word boundaries."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))


def word_key(term: str) -> str:
    """How a word or phrase looks inside :func:`padded_words`."""
    parts = [p for p in "".join(c if c.isalnum() or c == "_" else " " for c in term.lower()).split()]
    return " " + "  ".join(parts) + " "


def term_count(text: Column, term: str, match: str = "substring") -> Column:
    """Occurrences of a term: ``substring`` counts inside words too, ``word`` does not.

    ``text`` must be lower-cased (substring) or :func:`padded_words` (word).
    """
    return count_text(text, term.lower() if match == "substring" else word_key(term))


def prepared(text: str | Column, match: str = "substring") -> Column:
    """The form of the text that :func:`term_count` and :func:`has_term` expect."""
    source = F.coalesce(as_col(text), F.lit(""))
    return F.lower(source) if match == "substring" else padded_words(source)


def has_term(text: Column, term: str, match: str = "substring") -> Column:
    return text.contains(term.lower() if match == "substring" else word_key(term))


#: Term lists up to this length become one expression per term; longer ones are matched by one automaton.
EXPRESSION_TERMS = 64


def constants(values: Sequence[Any], kind: str) -> Column:
    """A list of any length as one constant array."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def _automaton(keys: Sequence[str]) -> Any:
    """All keys as one automaton that names the places of every key that ends at a character."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        if key:
            places.setdefault(key, []).append(i)
    machine = ahocorasick.Automaton()
    for key, at in places.items():
        machine.add_word(key, (len(key), at))
    if places:
        machine.make_automaton()
    return machine if places else None


def _counts(machine: Any, text: str) -> dict[int, int]:
    """How often each term occurs without overlapping itself, from left to right, by its place in the list."""
    free: dict[int, int] = {}
    hits: dict[int, int] = {}
    for last, (size, at) in machine.iter(text):
        first = at[0]
        if last - size + 1 >= free.get(first, 0):
            free[first] = last + 1
            for i in at:
                hits[i] = hits.get(i, 0) + 1
    return hits


def dictionary_counts(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    """Terms that occur as an array of (at, n): place in the list, ascending, and occurrences; what :func:`term_count` gives for each of them.

    One walk over the text finds the terms of the whole list, so the cost does not depend on their number. The list travels with the plan and must
    fit a Python worker. ``text`` must be :func:`prepared`; null text has no terms, an empty term none either.
    """
    keys = [t.lower() if match == "substring" else word_key(t) for t in terms]
    keys = [k if k.strip() else "" for k in keys] if match == "word" else keys

    @F.pandas_udf("array<struct<at:int,n:bigint>>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(keys)
        for batch in batches:
            found = [sorted(_counts(machine, t).items()) if machine and t else [] for t in batch]
            yield pd.Series([[{"at": i, "n": n} for i, n in f] for f in found], dtype=object)

    return walk(text)


def total_count(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    """Summed occurrences over a term list."""
    if len(terms) > EXPRESSION_TERMS:
        return F.aggregate(dictionary_counts(text, terms, match), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    out = F.lit(0).cast("long")
    for term in terms:
        out = out + term_count(text, term, match)
    return out


def found_terms(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    """The terms that occur, in list order."""
    if len(terms) > EXPRESSION_TERMS:
        return F.transform(dictionary_counts(text, terms, match), lambda x: F.get(constants(terms, "string"), x["at"]))
    return F.array_compact(F.array(*[F.when(has_term(text, t, match), F.lit(t)) for t in terms]))


def any_term(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    """Whether one of the terms occurs."""
    if len(terms) > EXPRESSION_TERMS:
        return F.size(dictionary_counts(text, terms, match)) > 0
    out = F.lit(False)
    for term in terms:
        out = out | has_term(text, term, match)
    return out


def words(value: str | Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(as_col(value), F.lit(""))), F.lit(WORD), F.lit(0))


def word_total(value: str | Column) -> Column:
    """Number of blank-separated words."""
    return F.size(F.regexp_extract_all(F.coalesce(as_col(value), F.lit("")), F.lit(r"[^\s]+"), F.lit(0))).cast("long")


def sentences(value: str | Column) -> Column:
    """Trimmed sentences that end in ``.``, ``!`` or ``?``; text without one is one sentence."""
    text = F.coalesce(as_col(value), F.lit(""))
    ended = F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.right(s, F.lit(1)).isin(".", "!", "?"))
    parts = F.filter(F.transform(ended, lambda s: strip(s)), lambda s: F.length(s) > 1)
    whole = F.when(F.length(strip(text)) > 0, F.array(strip(text))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern (or of one group), in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def extract_first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, null when there is none."""
    got = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)
    return F.when(got != "", got)
