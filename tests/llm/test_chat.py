import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, window int, loss string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def read(made):
    rows = made.select("*", chat.read_turns(F.col("formatted"), F.col("repeated")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("text")).collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["window"]):
        out[r["conv_id"]].append(r)
    return out


def test_query_agrees_with_the_table(spark, small):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op5_chat(spark, small).collect()}
    assert got.keys() == turns.keys()
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in rows).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > sum(len(t) for *_, t in rows)


def test_windows_round_trip_within_the_budget(spark):
    rng = random.Random(4)
    odd = ["</s>", "<s>[user]\n", "\\", "\\1", "\\\\0", "]\n", "[INST]", "é😀", "\n", " a b", "x"]
    rows = []
    for conv in range(40):
        system = rng.random() < 0.5
        for turn in range(rng.randint(1, 12)):
            role = "system" if system and turn == 0 else ("user", "assistant")[turn % 2] if rng.random() < 0.9 else rng.choice(odd)
            rows.append((conv, turn, role, "".join(rng.choices(odd, k=rng.randint(0, 25)))))
    made = read(chat.windows(frame(spark, rows), budget=60, history=20))
    for conv in range(40):
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for w in made[conv] for t in w["turns"]] == own
        assert "".join(w["text"] for w in made[conv]) == "".join(t for r, t in own if r == "assistant")
        for k, w in enumerate(made[conv]):
            assert w["tokens"] <= 60 or len(w["turns"]) == 1 or k == 0
            assert w["formatted"].count("</s>") == len(w["turns"]) + w["repeated"]
            if own[0][0] == "system":
                assert w["formatted"].startswith("<s>[system]\n")
    assert any(w["repeated"] > 1 for ws in made.values() for w in ws)


def test_edge_rows(spark):
    rows = [(1, 0, "system", "only"), (2, None, None, None), (None, 0, "user", "u"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "word " * 5000)]
    made = read(chat.windows(frame(spark, rows), budget=50, history=10))
    turns = {c: [(t.role, t.text) for w in ws for t in w["turns"]] for c, ws in made.items()}
    assert turns == {1: [("system", "only")], 2: [("", "")], None: [("user", "u")], 3: [("user", "same")] * 2, 4: [("assistant", "word " * 5000)]}
    assert chat.windows(frame(spark, [])).count() == 0


def test_native_plan(spark, small):
    plan = queries.op5_chat(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def plain_windows(rows, budget, history):
    """(begin, back, end) of each window, turn by turn: rows are (role, tokens) of a conversation."""
    first = int(rows[0][0] == "system")
    room = budget - (rows[0][1] if first else 0)
    out, used = [], 0
    for k in range(first, len(rows)):
        n = rows[k][1]
        if out and used + n <= room:
            used += n
        else:
            back, kept = k, 0
            while out and back > first and kept + rows[back - 1][1] <= min(history, room - n):
                back -= 1
                kept += rows[back][1]
            while out and back > first and rows[back - 1][1] == 0 and min(history, room - n) >= 0:
                back -= 1
            out.append([k, back])
            used = kept + n
    out = out or [[first, first]]
    return [(b, back, out[w + 1][0] if w + 1 < len(out) else len(rows)) for w, (b, back) in enumerate(out)]


def test_windows_agree_with_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for conv, n in enumerate([1, 2, 3, 7, 40, 200, 3000]):
        for turn in range(n):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant"])
            rows.append((conv, turn, role, f"t{turn}" + " w" * (rng.choice([1, 3, 9, 30]) - 1)))
    count = lambda text: F.regexp_count(text, F.lit(r"\S+")).cast("long")
    for budget, history in ((40, 15), (25, 25), (10, 0)):
        made = read(chat.windows(frame(spark, rows), budget=budget, history=history, tokens=count))
        for conv in range(7):
            own = [(role, text, len(text.split())) for c, _, role, text in rows if c == conv]
            first = int(own[0][0] == "system")
            expected = plain_windows([(r, n) for r, _, n in own], budget, history)
            assert len(made[conv]) == len(expected)
            for k, (w, (begin, back, end)) in enumerate(zip(made[conv], expected)):
                assert w["repeated"] == begin - back + (first if k else 0)
                assert w["formatted"] == "".join(f"<s>[{r}]\n{t}</s>" for r, t, _ in own[:first] + own[back:end])
                assert w["tokens"] == sum(n for *_, n in own[:first] + own[back:end])


def test_work_grows_with_the_turns(spark):
    """20,000 turns of one conversation, read back whole."""
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, repeat(' word', 20)) AS text")
    made = chat.windows(rows).select("window", chat.read_turns(F.col("formatted"), F.col("repeated")).alias("t"))
    got = [t.text for r in sorted(made.collect(), key=lambda r: r.window) for t in r.t]
    assert got == [f"turn {k}" + " word" * 20 for k in range(20_000)]


def test_chunks_change_no_window(spark, monkeypatch):
    """Conversations that are held ten turns at a time read as they do whole: this replaces a test that windows end with each chunk."""
    monkeypatch.setattr(chat, "CHUNK", 10)
    rng = random.Random(12)
    rows = []
    for conv, n in enumerate([1, 9, 10, 11, 20, 57, 130]):
        for turn in range(n):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "system"])
            role = "user" if turn == 0 and role == "system" and not conv % 2 else role
            rows.append((conv if conv != 5 else None, turn, role, f"t{turn}" + " w" * (rng.choice([1, 3, 9, 30]) - 1)))
    count = lambda text: F.regexp_count(text, F.lit(r"\S+")).cast("long")
    for budget, history in ((40, 15), (25, 25), (10, 0), (400, 300)):
        made = read(chat.windows(frame(spark, rows), budget=budget, history=history, tokens=count))
        for conv in (0, 1, 2, 3, 4, None, 6):
            own = [(role, text, len(text.split())) for c, _, role, text in rows if c == conv]
            first = int(own[0][0] == "system")
            expected = plain_windows([(r, n) for r, _, n in own], budget, history)
            found = [(k, begin - back + (first if k else 0), "".join(f"<s>[{r}]\n{t}</s>" for r, t, _ in own[:first] + own[back:end])) for k, (begin, back, end) in enumerate(expected)]
            assert [(w["window"], w["repeated"], w["formatted"]) for w in made[conv]] == found
            assert [(t.role, t.text) for w in made[conv] for t in w["turns"]] == [(r, t) for r, t, _ in own]
            assert "".join(w["text"] for w in made[conv]) == "".join(t for r, t, _ in own if r == "assistant")


def test_windows_of_16000_turns_agree_with_brute_force(spark):
    rows = spark.range(16_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, repeat(' word', int(id * 7 % 40))) AS text")
    made = chat.windows(rows).select("window", "formatted", "repeated", "tokens").orderBy("window").collect()
    own = [(("user", "assistant")[k % 2], f"turn {k}" + " word" * (k * 7 % 40)) for k in range(16_000)]
    expected = plain_windows([(r, len(t.split()) + 2) for r, t in own], 1024, 256)
    assert [(r.window, r.repeated, r.formatted) for r in made] == [(k, begin - back, "".join(f"<s>[{r}]\n{t}</s>" for r, t in own[back:end])) for k, (begin, back, end) in enumerate(expected)]
