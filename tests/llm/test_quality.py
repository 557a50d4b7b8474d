import re

from pyspark.sql import functions as F

from tests.llm.common import ODD, SCHEMA, empty, odd, some_docs
from tidemark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, duck):
    rows = ODD + [(100 + i, t) for i, t in some_docs(duck, 200)] + [(900, "a b c d e f g h a b c d e f g h i"), (901, "# x\n# x\n\n \n# x\n|"), (902, "same " * 7), (903, "same " * 8), (904, "same " * 9), (905, "\x0ba\x0cb\x85c\xa0d ")]
    got = quality.measures(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(str((r["doc_id"], *[r[c] for c in columns])) for r in got) == sorted(str((i, *brute(t))) for i, t in rows)


def test_weak_rules_find_the_bad_texts(spark):
    good = [(2000 + i, " ".join(f"word{i}x{j}" for j in range(60)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{i}###{j} $$$" for j in range(60))) for i in range(30)]
    got = {r["doc_id"]: r for r in quality.assess(spark, spark.createDataFrame(good + bad + ODD, SCHEMA)).collect()}
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    assert not got[2]["kept"] and got[2]["base_failed"] and not got[5]["kept"]


def test_rows(spark):
    assert quality.assess(spark, odd(spark)).count() == len(ODD)
    assert quality.assess(spark, empty(spark)).count() == 0


def test_fit_keeps_directions(spark):
    patterns = spark.createDataFrame([(1, 1, 900), (1, -1, 40), (-1, -1, 50), (0, 1, 10)], "a int, b int, n long")
    prior, shares = quality.fit(patterns, ["a", "b"])
    assert 0.5 < prior < 1 and all(shares[r, -1, 0] >= shares[r, -1, 1] and shares[r, 1, 1] >= shares[r, 1, 0] for r in "ab")


def test_runs_no_python(spark):
    plan = quality.measures(odd(spark)).select(F.sum("n_words"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
