import hashlib
import random

from tierspan.llm import chat


def test_escape_is_reversible():
    rng = random.Random(0)
    atoms = ["\\", "<", "turn>", "<turn>", "</turn>", "<text>", "#", "###", "/", "a", "\n", "é", " "]
    for _ in range(2000):
        turns = [("".join(rng.choices(atoms, k=rng.randint(0, 3))), "".join(rng.choices(atoms, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]
        text, _ = chat.render(turns)
        assert chat.parse(text) == turns


def test_formatting_round_trip(spark):
    long = "word " * 3000
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", " ok\n", 0), (1, 2, "assistant", "é漢 <turn>", 0), (2, 1, "assistant", None, 0), (2, 0, None, "q", 0), (3, None, "assistant", "x", 0), (3, None, "assistant", "x", 0), (None, 0, "assistant", long, 0), (-7, 0, "user", "\\### Assistant: </turn> ok", 0), (-7, 1, "assistant", "\\### Assistant: </turn> ok", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert len(got) == 5
    for conv in {r[0] for r in rows}:
        want = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, role, t in want if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(want)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in want).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0
