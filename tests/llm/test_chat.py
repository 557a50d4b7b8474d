import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(7)
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 0, None, None), (2, 0, "assistant", "\\0 \\1 \\\\ < <turn user> </turn>\n"), (None, 0, "a>b<c\\", "x"),
            (3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, 5, "assistant", "tie")]
    for c in range(10, 30):
        n = rng.randrange(1, 25)
        rows += [(c, i, "system" if i == 0 and c % 2 else rng.choice(["user", "assistant"]), "字 é w. " * rng.randrange(0, 60)) for i in range(n)]
    rows += [(99, i, "system" if i == 0 else ("assistant" if i % 2 else "user"), f"turn {i} " + "word " * (i % 9)) for i in range(2000)]
    return rows


def ordered(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


@pytest.mark.parametrize("budget,history", [(64, 12), (256, 64), (100_000, 0)])
def test_round_trip(spark, budget, history):
    rows = conversations()
    windows = chat.windows(spark.createDataFrame(rows, SCHEMA).repartition(4), budget=budget, history=history).persist()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    want = ordered(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert list(zip(got[c]["roles"], got[c]["texts"])) == turns
        assert got[c]["targets"] == [x for r, x in turns if r == "assistant"]
    for w in windows.where("conv_id = 99").collect():  # every window begins with the system turn
        assert w["formatted"].startswith("<turn system>turn 0 </turn>\n")
        assert w["window"] == 0 or w["n_repeated"] >= 1
    longest = max(r["m"] for r in spark.createDataFrame(rows, SCHEMA).select(chat.tokens(F.col("text")).alias("m")).where("m is not null").collect())
    if longest <= (budget - history) // 2:
        size = windows.select((F.regexp_count(F.regexp_replace("formatted", "<[^>]*>", " "), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))).alias("n")).agg(F.max("n")).first()[0]
        assert size <= budget + longest


def test_history_is_limited(spark):
    rows = [(1, i, "assistant", "a b c d e f g") for i in range(40)]  # ten tokens each
    got = chat.windows(spark.createDataFrame(rows, SCHEMA), budget=220, history=20).orderBy("window").collect()
    assert [w["n_repeated"] for w in got] == [0] + [2] * (len(got) - 1) and sum(len(w["loss"]) for w in got) == 40


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame(conversations(), SCHEMA).withColumns({c: F.lit(1) for c in ("window", "n", "span", "piece", "formatted")})
    assert chat.read_back(chat.windows(df)).count() == len(ordered(conversations()))
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0
    plan = chat.read_back(chat.windows(df))._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "MapInPandas" not in plan and "BatchEvalPython" not in plan


def test_escapes(spark):
    texts = ["\\", "\\1", "<\\0>", "</turn>\n", "", "\\\\<<"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape(F.col("t")).alias("e"))
    assert all(r["t"] == r["u"] and "<" not in r["e"] for r in df.collect())


@pytest.mark.parametrize("block", [3, 16])
def test_blocks_of_a_conversation(spark, monkeypatch, block):
    """Cutting conversations into small blocks changes nothing, with gaps, negative, null and equal numbers too."""
    odd = [(200, None, "user", "x " * 9), (200, -70, "system", "s"), (200, None, "user", "y"), (200, 10**15, "assistant", "last")] + [(200, 40, "assistant", f"{i} " * 30) for i in range(50)]
    odd += [(None, i * 1000, "assistant" if i % 2 else "user", "w " * (i % 50)) for i in range(120)]
    df = spark.createDataFrame(conversations() + odd, SCHEMA).repartition(5)
    found = []
    for size in (1 << 40, block):
        monkeypatch.setattr(chat, "BLOCK", size)
        found.append(sorted(map(str, chat.windows(df, budget=64, history=12).collect())))
    assert found[0] == found[1] and len(found[0]) > 200


def test_hot_conversation_is_cut(spark):
    """No window over texts is partitioned by the conversation alone."""
    df = spark.createDataFrame(conversations(), SCHEMA)
    turns = df.select(F.struct("conv_id").alias("conv"), "turn", "role", "text")
    plan = chat._positions(turns, 100)._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in plan.splitlines() if "windowspecdefinition(conv#" in line]
    assert len(specs) > 3 and all("block#" in line for line in specs)
