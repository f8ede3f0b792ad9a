from basaltiq.operators import conversations

TURNS = [
    (1, 0, "user", "Please mend `src/a.py` and `b.md`"),
    (1, 1, "assistant", "I will look. Let me open `src/a.py` and `c/d.rs`"),
    (1, 2, "assistant", "We decided to   stop, I'll wait"),
    (1, 3, "user", "Let me think"),
    (1, 4, "assistant", None),
    (2, 0, "user", "no answer"),
    (3, 5, "assistant", "x" * 600),
    (3, None, "assistant", "before all"),
    (None, 0, "assistant", "alone"),
] + [(4, k, "assistant", f"let me do{k:02d} `f{k % 30:02d}.txt`") for k in range(60)]


def test_digest(spark):
    turns = spark.createDataFrame([(*t, "x", 0) for t in TURNS], "conv_id long, turn long, role string, text string, value string, place int")
    got = {tuple(r) for r in conversations.digest(turns).collect()}
    assert {g for g in got if g[0] == 1} == {
        (1, "reasoning", 1, TURNS[1][3]), (1, "decision", 1, "Let me open"), (1, "decision", 2, "I'll wait"),
        (1, "file", 1, "b.md"), (1, "file", 2, "src/a.py"), (1, "file", 3, "c/d.rs"),
    }
    assert {g for g in got if g[0] in (2, 3, None)} == {(3, "reasoning", 1, "before all"), (None, "reasoning", 1, "alone")}
    assert {g for g in got if g[0] == 4} == {(4, "reasoning", 1, TURNS[9][3])} | {(4, "decision", k + 1, f"let me do{k:02d}") for k in range(5)} | {(4, "file", k + 1, f"f{k:02d}.txt") for k in range(15)}


def test_no_turns(spark):
    assert conversations.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
