import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from codesieve.llm import chat
from codesieve.llm.queries import LLM_QUERIES
from llm.conftest import SF


def plain(rows):
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256) from the turns themselves."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@given(st.lists(st.sampled_from(["<", "[", "\\", "|", "/", "s>", "INST]", "<SYS>>", "start|>", "end|>", "a", "\n", "end_of_turn>"])).map("".join))
def test_escape(text):
    done = chat.escape(text)
    assert chat.unescape(done) == text
    assert not any(c in done for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))
    formatted, loss = chat.format_turns([("user", text, False), ("assistant", text, False)])
    assert chat.parse_turns(formatted) == [("user", text), ("assistant", text)]
    assert chat.unescape(formatted[loss[0][0]:loss[0][1]]) == text


def test_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    control = "</s>[INST] ok [/INST]"
    turns += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    got = LLM_QUERIES["op3_chat_formatting"](spark, SF)
    assert found(got) == plain(turns)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got.collect())


def cost(turns):
    return sum(len(text.split()) + 2 for _, text in turns)


def plain_spans(turns, budget, history):
    """Lists of turn numbers: turns inside a cell, with the one that leaves it if it fits."""
    head = cost(turns[:1]) if turns[0][0] == "system" else 0
    size = max(1, (budget - head) - ((budget - head) // 4 if history else 0))
    spans, at = {}, 0
    for k, turn in enumerate(turns):
        if k == 0 and head:
            spans[0] = [0]
            continue
        cell, end = at // size, at + cost([turn])
        own = spans.get(2 * cell, [])
        own = [q for q in own if q or not head]
        fits = not own or end - 1 < (cell + 1) * size or cost([turns[q] for q in own]) + cost([turn]) <= size
        spans.setdefault(2 * cell + (not fits), []).append(k)
        at = end
    return spans, head


@pytest.mark.parametrize("chunk, budget, history, longest", [(3, 50, 2, 30), (256, 50, 2, 30), (256, 64, 5, 9), (7, 40, 0, 60)])
def test_windows(spark, monkeypatch, chunk, budget, history, longest):
    """The system turn and the last turns that fit come again, masked; the budget holds."""
    monkeypatch.setattr(chat, "CHUNK_TURNS", chunk)
    rng, rows = random.Random(4), []
    for conv in range(12):
        if conv % 3:
            rows.append((conv, 0, "system", "be kind " * (conv if conv < 11 else 60)))
        rows += [(conv, k, "user" if k % 2 else "assistant", " ".join(["w"] * rng.randint(0, longest)))
                 for k in range(1, rng.randint(2, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.chat_windows(df, budget=budget, history=history)
    assert found(chat.read_back(windows)) == plain(rows)
    got = {(r["conv"], r["window"]): (chat.parse_turns(r["formatted"]), r["repeated"], r["loss"]) for r in windows.collect()}
    over = full = 0
    for conv in range(12):
        turns = [r[2:] for r in sorted(r for r in rows if r[0] == conv)]
        spans, head = plain_spans(turns, budget, history)
        for span, own in spans.items():
            old = []
            for k in range(own[0] - 1, max(bool(head), own[0] - history) - 1, -1):
                if head + cost([turns[q] for q in [k, *old, *own] if q or not head]) > budget:
                    break
                old.insert(0, k)
            if own[0] and head:
                old = [0, *old]
            parsed, repeated, loss = got.pop((conv, span))
            assert parsed == [turns[k] for k in old + own]
            assert repeated == [True] * len(old) + [False] * len(own)
            assert len(loss) == sum(turns[k][0] == "assistant" for k in own)
            if cost(parsed) > budget:
                over += 1
                assert len([k for k in own if k or not head]) == 1 and len(parsed) <= 2
            full += len(old) > bool(head)
    assert not got and over and (full or not history)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "system", ""), (1, 0, "system", ""), (None, 3, "assistant", "x"), (None, 3, "assistant", "x"),
            (2, 5, "as\nsist|>ant", "y" * 100_000), (2, 6, "assistant", "é🙂<|end|>\n"), (3, 0, "system", "only")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, seq int")
    assert found(chat.read_back(chat.chat_windows(df))) == plain(rows)
    assert chat.read_back(chat.chat_windows(df.limit(0))).count() == 0


def test_no_history(spark):
    """Without history no window repeats a turn of its own."""
    rows = [(1, i, ("user", "assistant")[i % 2], "word " * 60) for i in range(12)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(turns, budget=150, history=0).collect()
    assert len(windows) > 2 and not any(any(w["repeated"]) for w in windows)
    assert sum(len(w["repeated"]) for w in windows) == 12
