"""Chat windows: round trip, budget, mask, defined cases; native plan."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from playtape.llm import chat

ROWS = "conv_id long, turn long, role string, text string, span int, window string"
TRICKS = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\", "\\\\<|", "<\\|end|>", "a<", "|>", "<", "", None, "<|end|>\\", "[/INST]<s><|"]


def rows_of(spark, conversations):
    return spark.createDataFrame([(c, t, r, x, 1, "clash") for c, turns in conversations.items() for t, (r, x) in enumerate(turns)], ROWS)


def sample():
    rng = random.Random(9)
    out = {None: [("user", "who"), (None, "null role"), ("assistant", None)], 1: [("system", "only")], 2: [("tool|>", "x"), ("<|", "y")]}
    for c in range(3, 40):
        turns = [("system", "be kind " * rng.randrange(1, 20))] if rng.random() < 0.4 else []
        for i in range(rng.randrange(0, 14)):
            text = rng.choice(TRICKS) if rng.random() < 0.4 else "word " * rng.choice([1, 10, 60, 300])
            turns.append(("user" if i % 2 == 0 else "assistant", text))
        out[c] = turns
    return out


def test_round_trip_budget_and_mask(spark):
    given_turns = sample()
    df = rows_of(spark, given_turns)
    budget, history = 200, 40
    made = chat.windows(df, budget, history)
    read = {}
    for r in chat.read_back(made).collect():
        read.setdefault(r.conv_id, []).append((r.window, r.place, r.role, r.text))
    want = {c: [(r or "", t or "") for r, t in turns] for c, turns in given_turns.items() if turns}
    assert {c: [x[2:] for x in sorted(v)] for c, v in read.items()} == want
    learned = {}
    for r in chat.learned_text(made).collect():
        learned.setdefault(r.conv_id, []).append((r.window, r.learned))
    assert {c: "".join(t for _, t in sorted(v)) for c, v in learned.items()} == {
        c: "".join(t for r, t in turns if r == "assistant") for c, turns in want.items()}
    tokens = lambda t: -(-len(t) // 4) + chat.MARKER_TOKENS
    for r in made.collect():
        turns = [x for x in r.formatted.split("<|end|>\n")[:-1]]
        owned = [x for i, x in enumerate(turns[r.repeated:]) if r.window or i or not x.startswith("<|system|>")]
        size = sum(tokens(bytes(x.split("|>\n", 1)[1], "utf8").decode()) for x in turns)
        assert size <= budget * 1.3 or len(owned) <= 1  # a long turn stands alone; escapes are not counted as tokens
        if r.window and want[r.conv_id][0][0] == "system":
            assert turns[0].startswith("<|system|>")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["end", "\\end", "end|>", "|end|", "", "assistant"]), st.text(alphabet="end|><\\\n/", max_size=6)),
                          st.text(alphabet="<|>\\end\n", max_size=12)), min_size=1, max_size=8))
def test_no_role_closes_a_turn(spark, turns):
    made = chat.windows(rows_of(spark, {1: [("user", "first"), ("end", "x"), *turns]}), 30, 5)
    read = sorted((r.window, r.place, r.role, r.text) for r in chat.read_back(made).collect())
    assert [x[2:] for x in read] == [("user", "first"), ("end", "x"), *turns]
    learned = "".join(r.learned for r in sorted(chat.learned_text(made).collect(), key=lambda r: r.window))
    assert learned == "".join(t for r, t in turns if r == "assistant")


def test_history_is_what_stood_before(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i} " + "x" * 60) for i in range(30)]
    made = sorted(chat.windows(rows_of(spark, {1: turns}), 200, 40).collect(), key=lambda r: r.window)
    seen = 0
    for r in made:
        parts = r.formatted.split("<|end|>\n")[:-1]
        numbers = [int(p.split("turn ")[1].split()[0]) for p in parts]
        assert numbers == list(range(numbers[0], numbers[0] + len(numbers))) and numbers[r.repeated] == seen
        assert r.window == 0 or 1 <= r.repeated <= 2
        seen = numbers[-1] + 1
    assert seen == 30


def test_digest_of_ties_repeats_and_no_rows(spark):
    df = rows_of(spark, {1: [("user", "a"), ("assistant", "b")]})
    twice = chat.chat_digest(df.unionByName(df), 100, 10).collect()
    assert [(r.n_turns, r.loss_chars) for r in twice] == [(4, 2)]
    assert chat.chat_digest(df.limit(0), 100, 10).collect() == []


def test_no_python_in_the_plan(spark):
    plan = chat.chat_digest(rows_of(spark, sample()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|>\\/s[]INTend \n"), min_size=1, max_size=20))
def test_escape_is_reversible_and_leaves_no_marker(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))
