"""Formatted conversations: a plain parser, hostile texts, spans under the mask, defined cases."""

import hashlib
import random

import duckdb

from residua.llm.chat_format import chat_digests, chat_sql, format_chats, with_probe

PIECES = ["\\", "\\\\", "### ", "###", " ", "</turn>", "\n</turn>\n", "</turn", ">", "### user: ", "### Assistant: ", ": ", "\n", "a", "é", "𝄞", "%", "#", "$1", "\r\n", ""]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, c int"


def hostile(rows=400):
    rng = random.Random(5)
    out = []
    for i in range(rows):
        role = rng.choice(["user", "assistant", "system", "", None, "Tool: x", "### a", "a\nb", "é"])
        text = rng.choice([None, "".join(rng.choices(PIECES, k=rng.randrange(9)))])
        out.append((rng.choice([None, i % 40]), rng.choice([None, rng.randrange(5)]), role, text, "x", 1))
    return out + [(1000, 1, "assistant", "\\" * 200_000 + "### " + "word " * 200_000, "x", 1)]


def plain_read(s):
    """A character-by-character reader of the grammar."""
    turns, i = [], 0
    while i < len(s):
        assert s.startswith("### ", i)
        i += 4
        j = s.index(": ", i)
        name, i = s[i:j], j + 2
        out = []
        while not s.startswith("\n</turn>\n", i):
            for c in ("### ", "</turn>"):
                assert not s.startswith(c, i), "a control string stands bare"
                if s.startswith("\\" + c, i):
                    out.append(c)
                    i += 1 + len(c)
                    break
            else:
                out.append(s[i])
                i += 1
        turns.append((bytes.fromhex(name[1:]).decode() if name[0] == "%" else name, "".join(out)))
        i += 9
    return turns


def key(row):
    return (row[1] is not None, row[1] or 0, (row[2] or "").encode(), (row[3] or "").encode())


def test_every_turn_comes_back(spark):
    rows = hostile()
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in rows} and all(r.identical for r in got.values())
    for c, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=key)]
        assert plain_read(r.formatted) == want
        for (role, text), span in zip(want, r.turns, strict=True):
            piece = r.formatted[span.start : span.start + span.length]
            assert span.role == role and span.loss == (role == "assistant")
            assert piece == text.replace("### ", "\\### ").replace("</turn>", "\\</turn>")


def test_texts_without_control_strings_are_left_alone(spark):
    text = "C:\\dir\\### no blank? a \\\\ b # ## </turn"
    [r] = format_chats(spark.createDataFrame([(1, 0, "user", text.replace("### ", "###"), "", 0)], SCHEMA)).collect()
    assert r.formatted == f"### user: {text.replace('### ', '###')}\n</turn>\n"


def test_digests_against_hashlib_and_sql(spark):
    rows = [r for r in hostile() if r[0] is not None]
    frame = with_probe(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in chat_digests(format_chats(frame)).collect()}
    for c, r in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=key) if c != -7 else [(c, 0, "user", "\\### Assistant: </turn> ok"), (c, 1, "assistant", "\\### Assistant: </turn> ok")]
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        lost = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toPandas())
    sql = con.execute(chat_sql()).fetchall()
    assert {(r[0], *r[1:]) for r in sql} == {tuple(r) for r in got.values()}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert format_chats(none).count() == 0
    [probe] = chat_digests(format_chats(with_probe(none))).collect()
    assert probe.conv_id == -7 and probe.n_turns == 2 and probe.loss_chars == 26


def test_no_python_worker_and_one_exchange(spark):
    rows = spark.createDataFrame(hostile(), SCHEMA)
    plan = chat_digests(format_chats(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
