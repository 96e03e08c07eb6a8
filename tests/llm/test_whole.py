"""Long system turns and long histories are whole."""

from mapgauge.llm import chat


def test_a_long_system_turn_is_in_every_window(spark):
    for size in (300, 600):  # more than half the budget of 512, more than all of it
        said = "s " * size
        t = [(1, 0, "system", said), *((1, k, "user" if k % 2 else "assistant", "w " * 60) for k in range(1, 30))]
        found = chat.windows(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
        assert len(found) > 3
        for r in found:
            parsed = chat.parse(r["text"])
            assert parsed[0] == ("system", said)
            assert r["over"] == (r["n_tokens"] > 512) and (not r["over"] or r["last_turn"] == r["first_turn"])
        assert sum(r["last_turn"] - r["first_turn"] + 1 for r in found) == 30


def test_history_is_bounded_by_tokens_alone(spark):
    t = [(1, k, "user", "w") for k in range(300)]
    found = chat.windows(spark.createDataFrame(t, "conv_id long, turn long, role string, text string"), budget=1000, history=500, overhead=4).orderBy("window").collect()
    assert [r["repeated"] for r in found] == [0, 100] and found[1]["first_turn"] == 200
