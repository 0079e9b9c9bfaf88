import random
import zlib

import numpy as np

from featherlens.llm import chat


def brute(model, rows):
    """Viterbi over a whole conversation's lines at once."""
    score, back = None, []
    for lines in rows:
        for i, line in enumerate(lines):
            emit, marked = model.emission(line, i == 0)
            if score is None:
                score = model.start + emit
                continue
            o = score[:, None] + (model.move if i == 0 else model.turn if marked else model.stay)
            back.append(o.argmax(0))
            score = o.max(0) + emit
    path = [int(score.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return path[::-1]


def conversations():
    rng = random.Random(2)
    rows = []
    for c in range(40):
        turns = [("system", 1)] * (c % 3 == 0) + [("user", 1), ("assistant", 4)] * rng.randrange(1, 5)
        if c == 7:
            turns = [("user", 1), ("assistant", 3)] * 60
        for t, (role, n) in enumerate(turns):
            rows.append((c, t, role, "\n".join("word " * rng.randrange(2, 20 if role == "user" else 90) for _ in range(rng.randrange(1, n + 1)))))
    return rows


def test_segments_equal_one_pass(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_ROWS", 3)
    rows = conversations() + [(None, 0, "user", "hi"), (None, 1, "assistant", "yes " * 50), (50, None, None, None), (51, 0, "user", ""), (52, 0, "user", "same"), (52, 0, "user", "same"), (53, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seg int")
    model = chat.fit(df)
    raw = chat.as_transcript(df)
    got = chat.recover(raw, model).collect()
    by = {}
    for r in raw.collect():
        by.setdefault(r.conv_id, []).append(r)
    want = []
    for conv, part in by.items():
        part.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.text))
        lines = [r.text.split("\n") for r in part]
        path, at = brute(model, lines), 0
        for r, x in zip(part, lines, strict=True):
            text, n = chat.render(x, "".join(map(str, path[at : at + len(x)])))
            want.append((conv, r.turn, zlib.crc32(("" if conv is None else str(conv)).encode()) % 5 == 0, chat.ROLES[path[at]], len(x), n, text))
            at += len(x)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    truth = {(c, t): role for c, t, role, _ in rows}
    hits = [r.role == truth[r.conv_id, r.turn] for r in got if r.conv_id is not None and r.conv_id < 50]
    assert np.mean(hits) > 0.95
    assert not any("User:" in r.rendered or "### " in r.rendered for r in got)


def test_markers():
    assert chat.marker("Human: hi") == (1, "hi") and chat.marker("### Assistant") == (2, "") and chat.marker("[system] be nice") == (0, "be nice")
    assert chat.marker("A quiet day") == (None, "A quiet day") and chat.marker("") == (None, "")
    for content in ("A", "AI", "q", "user", "Human", "system", "a]", "[a]", "### A", "A quiet day: here", "users: many"):
        assert chat.marker(content) == (None, content)
    assert chat.marker("A:") == (2, "") and chat.marker("AI: yes") == (2, "yes") and chat.marker("### user ") == (1, "")
    assert chat.render(["User: a", "b", "AI: c"], "112") == ("<|user|>\na\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n", 2)


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_nothing_but_markers_goes(spark):
    assert chat.render(["Blood type:", "A", "that is all"], "222") == ("<|assistant|>\nBlood type:\nA\nthat is all\n<|end|>\n", 1)
    # a list item with a letter, and a quoted marker of another role, are content where the role doesn't change
    assert chat.render(["Options:", "A: red", "Q: why", "User: said so"], "2222")[0] == "<|assistant|>\nOptions:\nA: red\nQ: why\nUser: said so\n<|end|>\n"
    assert chat.render(["User: a"], "2")[0] == "<|assistant|>\nUser: a\n<|end|>\n"
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    listed = [(900, 0, "user", "which one?"), (900, 1, "assistant", "Assistant: these\nA: red paint\nA: blue paint\nA\nAI\n" + "word " * 60)]
    got = {r.turn: r.rendered for r in chat.recover(spark.createDataFrame(listed, df.schema), chat.fit(df)).collect()}
    assert got[1].startswith("<|assistant|>\nthese\nA: red paint\nA: blue paint\nA\nAI\nword")


def test_segments_are_bounded_in_characters(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model, raw = chat.fit(df), chat.as_transcript(df)
    want = sorted(map(str, chat.recover(raw, model).collect()))
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 50)
    assert sorted(map(str, chat.recover(raw, model).collect())) == want
