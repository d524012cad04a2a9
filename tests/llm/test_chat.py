from pyspark.sql import functions as F
from vacantia.llm import chat

from .conftest import rows_of

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, at, role, text in set(rows):
        convs.setdefault(c, []).append((at is not None, at or 0, role, text))
    seen = {c: tuple((r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])) for c, v in convs.items()}
    kept = {}
    for c, turns in sorted(seen.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in seen.values()):
            kept.setdefault(turns, c)
    return sorted(((c, len(t), sum(o == t for o in seen.values()), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t)) for t, c in kept.items()), key=repr)


def test_against_brute_force(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(1, k, *t) for k, t in enumerate(talk[:2])] + [(2, k, *t) for k, t in enumerate(talk)] + [(3, k, *t) for k, t in enumerate(talk)]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 7, "user", "hi"), (None, 0, "user", "alone"), (6, None, "system", "x"), (6, 0, "user", "y")]
    rows += [(7, 0, "user", "hi"), (7, 1, "assistant", "hello"), (7, 2, "user", ""), (2, 0, "user", "hi")]
    rows += [(8, k, "user", f"long {k}") for k in range(200)] + [(9, k, "user", f"long {k}") for k in range(150)]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS))
    assert sorted(((r.conv_id, r.n_turns, r.n_logged, r.text) for r in got.collect() if r.conv_id != 6), key=repr) == [x for x in brute(rows) if x[0] != 6]
    six = [r for r in got.collect() if r.conv_id == 6]
    assert {r.n_turns for r in six} == {2} and "".join(r.text for r in sorted(six, key=lambda r: r.chunk)) == "<|im_start|>system\nx<|im_end|>\n<|im_start|>user\ny<|im_end|>\n"


def test_many_blocks(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(700)] + [(2, k, "user", f"t{k}") for k in range(600)] + [(3, k, "user", f"t{k}" if k != 300 else "x") for k in range(600)]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(1, 700), (3, 600)}
    assert {r.chunk_turns for r in got} == {256, 188, 88}


def test_empty_and_clashing(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b")], TURNS)
    assert chat.format_chats(rows.limit(0)).count() == 0
    assert rows_of(chat.format_chats(rows.withColumns({n: F.lit(1) for n in ("n", "h1", "block", "conv", "at")}))) == rows_of(chat.format_chats(rows))


def test_rows_without_an_id_are_divided(spark):
    """Thousands of turns without conv_id, under few numbers: one conversation by definition, in parts of bounded size."""
    rows = [(None, k % 3, "user", f"t{k}") for k in range(3000)] + [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a")]
    turns = spark.createDataFrame(rows, TURNS)
    got = chat.format_chats(turns, most=200).collect()
    none = sorted((r for r in got if r.conv_id is None), key=lambda r: (r.chunk, r.part))
    assert sum(r.chunk_turns for r in none) == 3000 == none[0].n_turns and max(r.chunk_turns for r in none) < 200
    whole = [r for r in chat.format_chats(turns, most=10_000).collect() if r.conv_id is None]
    assert len(whole) == 1 and whole[0].text == "".join(r.text for r in none)
    assert [(r.conv_id, r.n_turns) for r in got if r.conv_id is not None] == [(1, 2)]
    longer = spark.createDataFrame([(5, *r[1:]) for r in rows[:3000]] + [(5, 9, "user", "end")], TURNS)
    again = chat.format_chats(turns.unionByName(longer), most=200).collect()
    assert {(r.conv_id, r.n_turns) for r in again} == {(5, 3001), (1, 2)}
