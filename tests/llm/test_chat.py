"""Chat formatting: black-box templates, and the tables against plain Python."""

import hashlib
import random
import re

import duckdb
import pytest

from ixpanel.llm import chat
from ixpanel.llm.common import table

SF = "/root/testdata/sf0.01"
ODD = ["", "x", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "<\\\\|", "<", "<<||>", "|im_end|>",
       "a<", "\\", "\n", "\r\n", "ä💥▁", "b", "a", "<|", "tail <\\", "ab" * 3]


def test_texts_and_roles_come_back():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a\nb", "\\n", "<|im_end|>", ""]),
                  "".join(rng.choice(ODD) for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(0, 6))]
        text = chat.render(turns)
        assert chat.read(text) == turns
        assert text.count(chat.START) == text.count(chat.END) == len(turns)
    with pytest.raises(ValueError):
        chat.read(chat.START + "user\nno end")


def test_spans_and_mask_of_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(ODD) + rng.choice(ODD)) for _ in range(rng.randint(1, 7))]
        context = [("user", rng.choice(ODD)) for _ in range(rng.randint(0, 3))]
        got = chat.incremental(chat.render, turns, context)
        assert got.rewritten_at is None and got.text == chat.render(turns)
        assert [got.text[a:b] for a, b in got.spans] == [chat.render([t]) for t in turns]
        assert [chat.unescape(got.text[a:b]) for a, b in got.mask] == [t for r, t in turns if r == "assistant"]


def with_end(turns):
    """Marks the end of what there is, which goes when another turn follows."""
    return "[BOS]" + "".join(f"[{r}]{t}" for r, t in turns) + "[EOS]"


def forgetful(turns):
    """Thoughts stay in the last turn alone."""
    last = len(turns) - 1
    return "".join(f"[{r}]" + (t if k == last else re.sub(r"\{.*?\}", "", t)) + ";" for k, (r, t) in enumerate(turns))


def only_last_two(turns):
    return "".join(f"[{r}]{t};" for r, t in turns[-2:])


def test_rewritten_history_is_found():
    turns = [("user", "aa"), ("assistant", "ba{hm}b"), ("user", "[EOS]"), ("assistant", "a{so}")]
    got = chat.incremental(with_end, turns)
    assert got.rewritten_at == 1 and [got.text[a:b] for a, b in got.spans] == [t for _, t in turns]
    assert [got.text[a:b] for a, b in got.mask] == ["ba{hm}b", "a{so}"]
    got = chat.incremental(forgetful, turns)
    assert got.rewritten_at == 2 and [got.text[a:b] for a, b in got.mask] == ["bab", "a{so}"]
    got = chat.incremental(only_last_two, turns)
    assert got.rewritten_at == 2 and got.spans[:2] == [None, None]
    assert [got.text[a:b] for a, b in got.mask] == ["a{so}"]
    assert chat.incremental(forgetful, [("user", "a{b}")]).rewritten_at is None
    # A block behind context: neither rewriting nor longer memory can be cut.
    assert chat.incremental(with_end, turns[1:], turns[:1]).text is None
    numbered = lambda ts: "".join(f"{len(ts) - len(ts) + k}:{t};" for k, (_, t) in enumerate(ts))
    assert chat.incremental(numbered, turns[2:], turns[:2]).text is None


def expected(rows):
    """conv_id -> what the query returns, in plain Python."""
    out, key = {}, lambda r: ((r[1] is not None, r[1] or 0), (r[2] or "").encode(), (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        lost = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), sha(lost),
                     len(chat.render(turns)))
    return out


COLUMNS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def given(df):
    rows = [(r.conv_id, tuple(r[c] for c in COLUMNS)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_query_like_plain_python_and_sql(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat.ODD), (-1, 1, "assistant", chat.ODD)]
    got = given(chat.query(spark, SF))
    assert got == expected(rows) and -1 in got
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{SF}/conversations.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(
        f"select conv_id, {', '.join(COLUMNS)} from ({chat.SQL})").fetchall()} == got


ROWS = "conv_id long, turn long, role string, text string, block string, own long, formatted string"


@pytest.mark.parametrize("block, memory", [(64, 8), (4, 1), (2, 1), (5, 4)])
def test_long_and_odd_conversations(spark, block, memory):
    rng = random.Random(block)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(ODD)) for k in range(150)]
    rows += [(None, rng.choice([None, 1, 2]), rng.choice([None, "assistant"]), rng.choice([None, *ODD])) for _ in range(40)]
    rows += [(2, 5, "assistant", "same")] * 90 + [(3, None, None, None), (4, 0, "user", "x" * 200_000), (5, 0, "assistant", None)]
    rows += [(6, k, "user", "y") for k in range(64)] + [(7, k, "assistant", "z") for k in range(65)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "b", 1, "f") for r in rows], ROWS)
    formatted = chat.format_chats(df, block=block, memory=memory)
    assert given(chat.read_back(formatted)) == expected(rows)
    # No block holds more than its turns.
    assert max(len(r.spans) for r in formatted.collect()) <= block


def test_templates_that_cannot_be_cut(spark):
    df = spark.createDataFrame([(1, k, "assistant", "t") for k in range(9)] + [(2, 0, "assistant", "t"), (2, 1, "user", "u")],
                               "conv_id int, turn int, role string, text string")
    def ended(turns):           # as with_end; workers don't have this module
        return "[BOS]" + "".join(f"[{r}]{t}" for r, t in turns) + "[EOS]"

    template = chat.Template(ended, lambda s: [("?", x) for x in s[5:-5].split("[")[1:]], str)
    rows = {(r.conv_id, r.block): r for r in chat.format_chats(df, template, block=4, memory=2).collect()}
    assert rows[2, 0].rewritten_at == 1 and rows[2, 0].formatted == "[BOS][assistant]t[user]u[EOS]"
    assert {k for k, r in rows.items() if r.formatted is None} == {(1, 1), (1, 2)}
    got = given(chat.read_back(chat.format_chats(df, template, block=4, memory=2), template))
    assert got[1] == (None,) * 5 and got[2][2] == 1
    assert given(chat.read_back(chat.format_chats(df.where("false")))) == {}
    with pytest.raises(ValueError):
        chat.format_chats(df, block=4, memory=4)
