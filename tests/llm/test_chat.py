import hashlib
import random
import time

import pytest

from compare import assert_same, views
from cuelake.llm import chat, registry


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query_equals_sql(spark, sf_dir):
    assert_same(registry.queries()["op10_chat_format"](spark, sf_dir), registry.oracle_sql()["op10_chat_format"], views(sf_dir))


def test_query_on_a_small_table(spark, tmp_path):
    r = random.Random(4)
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\\\<\\s>", "", None, "x" * 900, "long " * 2000, "é\n", "<<SYS>>a<</SYS>>"]
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], r.choice(odd)) for c in range(12) for t in range(r.randint(1, 30))]
    rows += [(50, 0, "system", "a"), (50, 1, "system", "b"), (51, 0, "assistant", None), (None, 0, None, None), (52, 1, "user", "x"), (52, 1, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    convs = {}
    for c, t, role, text in [*rows, (-1, 0, "user", odd[0]), (-1, 1, "assistant", odd[0])]:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    got = {x.conv_id: x for x in registry.queries()["op10_chat_format"](spark, str(tmp_path)).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns, loss, x = sorted(turns), "".join(t for _, role, t in sorted(turns) if role == "assistant"), got[c]
        assert (x.n_turns, x.turns_sha256) == (len(turns), digest("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (x.loss_chars, x.loss_sha256) == (len(loss), digest(loss)) and x.formatted_chars >= sum(len(t) for _, _, t in turns)


def seconds(spark, n):
    text = "word " * 40
    df = spark.range(n).selectExpr("1L as conv_id", "cast(id as int) as turn", "case when id % 2 = 0 then 'user' else 'assistant' end as role", f"'{text}' as text")
    best = 1e9
    for _ in range(2):
        began = time.time()
        assert chat.read_back(chat.windows(df)).selectExpr("size(turns) as n").first().n == n
        best = min(best, time.time() - began)
    return best


def test_cost_is_linear_in_the_length_of_a_conversation(spark):
    seconds(spark, 100)
    assert seconds(spark, 8000) < 4.5 * max(seconds(spark, 2000), 0.5)


@pytest.mark.parametrize("budget", [40, 512, 5000])
def test_budgets(spark, budget):
    rows = [(1, t, ("user", "assistant")[t % 2], "y" * (t * 37 % 300)) for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    wins = chat.windows(df, budget).collect()
    assert sum(w.n_own for w in wins) == 200 and sorted(w.window_no for w in wins) == list(range(len(wins)))
    assert all(w.n_tokens <= max(budget, 2 * 32) or w.n_own == 1 for w in wins)
