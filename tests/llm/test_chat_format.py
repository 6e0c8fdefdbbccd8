from __future__ import annotations

import hashlib
import math
import random
import re

from diffmill.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|says|>", "<|done|>", "<|im_end|>", "\\", "\\\\", "<\\|", "<", "[", "\n", "<bos>"]


def esc(t):
    return re.sub(c.CONTROL, lambda m: m[0] + "\\", t.replace("\\", "\\\\"))


def brute(rows, budget, history):
    """The windows of each conversation, and the digests of its turns."""
    convs, out = {}, {}
    for r in rows:
        convs.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, turns in convs.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        say = [f"{c.START}{esc(r)}{c.MIDDLE}{esc(t)}{c.END}" for _, _, r, t in turns]
        tok = [math.ceil(len(s.encode()) / 4) for s in say]
        sys = turns[0][2] == "system" and tok[0] * 2 <= budget and len(turns) > 1
        room = max(budget - history - sys * tok[0], 1)
        starts = [0]
        used = tok[0]
        for i in range(1, len(turns)):
            if used + tok[i] > (budget if len(starts) == 1 else room):
                starts.append(i)
                used = 0
            used += tok[i]
        windows = []
        for s, e in zip(starts, [*starts[1:], len(turns)], strict=True):
            h = s
            while s and h > sys and sum(tok[h - 1 : s]) <= history:
                h -= 1
            lead = [0] if sys and h > 0 and s else []
            windows.append(("".join(say[i] for i in [*lead, *range(h, e)]), s - h + len(lead), e - s, sum(tok[i] for i in [*lead, *range(h, e)])))
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (windows, (conv, len(turns), sha(said), len(loss), sha(loss), sum(len(w[0]) for w in windows)))
    return out


def check(spark, rows, budget, history):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", window int, loss string")
    windows = c.format_chats(turns, budget, history)
    want = brute(rows, budget, history)
    got = {}
    for w in windows.collect():
        got.setdefault(w.conv_id, {})[w.window] = (w.text, w.n_repeated, w.n_turns, w.n_tokens)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert sorted(map(tuple, c.read_back(windows).collect()), key=str) == sorted((v[1] for v in want.values()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 5, 30])):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool\n", None])
            text = "".join(rng.choice([*CONTROL, "word ", "é", "\U0001f600"]) for _ in range(rng.choice([0, 1, 5, 40])))
            rows.append((conv, turn if conv % 5 else None, role, rng.choice([text, text, None])))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (99, 0, "system", "y" * 3000), (99, 1, "assistant", "z" * 5000)]
    for budget, history in ((1024, 256), (60, 20), (40, 0), (1, 1)):
        check(spark, rows, budget, history)


def test_loss_spans_name_assistant_texts_once(spark):
    rows = [(1, 0, "system", "s"), *[(1, i, "assistant" if i % 2 else "user", f"t{i} <|done|>") for i in range(1, 30)]]
    windows = c.format_chats(spark.createDataFrame(rows, SCHEMA), 60, 25).orderBy("window").collect()
    assert len(windows) > 3 and any(w.n_repeated > 1 for w in windows)
    spans = [w.text[s.start : s.start + s.length] for w in windows for s in w.loss]
    assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in spans] == [t for _, _, r, t in rows if r == "assistant"]
    assert all(w.text.startswith("<|turn|>system<|says|>s<|done|>") for w in windows)


def test_no_rows(spark):
    assert c.read_back(c.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_one_long_conversation(spark):
    turns = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 1, 'assistant', 'user') AS role", "concat('turn ', id) AS text")
    row = c.read_back(c.format_chats(turns)).collect()
    assert len(row) == 1 and row[0].n_turns == 3000 and row[0].loss_chars == sum(len(f"turn {i}") for i in range(1, 3000, 2))


def test_given_tokens(spark):
    rows = [(1, i, "user", "x", 10) for i in range(6)]
    windows = c.format_chats(spark.createDataFrame(rows, SCHEMA + ", n int"), 20, 0, tokens_col="n").collect()
    assert sorted((w.window, w.n_turns, w.n_tokens) for w in windows) == [(0, 2, 20), (1, 2, 20), (2, 2, 20)]
