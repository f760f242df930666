"""Role repair against the cheapest of all readings."""

import itertools

import pytest

from quire.llm import chat


def brute(roles):
    """The least cost over all roles, merges and empty turns, by breadth-first search over costs."""
    import heapq

    heap, seen = [(0, 0, "")], set()
    while heap:
        cost, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and (s in chat.FINAL or s == ""):
            return cost
        for r in chat.NEXT[s]:
            heapq.heappush(heap, (cost + chat.INSERT, i, r))
        if i < len(roles):
            for r in chat.ROLES:
                c = 0 if r == roles[i] else chat.UNNAMED if roles[i] is None else chat.RELABEL
                if r in chat.NEXT[s]:
                    heapq.heappush(heap, (cost + c, i + 1, r))
                if r == s:
                    heapq.heappush(heap, (cost + c + chat.MERGE, i + 1, r))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_cost_is_least(n):
    for roles in itertools.product((*chat.ROLES, None), repeat=n):
        cost, steps, ending = chat.repair(list(roles))
        assert cost == brute(roles), roles
        seq = []
        for role, merged, way in steps:
            seq += way
            if not merged:
                seq.append(role)
            assert not merged or seq[-1] == role
        seq += ending
        at = ""
        for r in seq:
            assert r in chat.NEXT[at]
            at = r
        assert at in chat.FINAL or not roles


def test_cases(spark):
    rows = [
        (1, 0, "user", "hi", 5), (1, 1, "assistant", "yo", 5), (2, 0, "human", "a", 5), (2, 1, "User ", "b", 5), (2, 1, "User ", "b", 5), (3, 0, "assistant", None, 5),
        (None, 0, None, "who", 5), (4, None, "system", "", 5), (5, 0, "user", "x" * 300_000, 5), (6, 0, "user", "a <|im_end|> b", 5), (7, 0, "zzz", "odd", None), (7, 0, "zzz", "odder", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert out[1].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n" and out[1].cost == 0
    assert (out[2].n_turns, out[2].n_out, out[2].merged) == (2, 1, 1) and "a\nb" in out[2].text
    assert out[3].relabelled == 1 and out[3].text == "<|im_start|>user\n<|im_end|>\n"
    assert out[None].text.startswith("<|im_start|>user\nwho")
    assert out[4].n_out == 1 or out[4].inserted == 1
    assert len(out[5].text) > 300_000
    assert out[6].text.count("<|im_end|>") == 1
    assert out[7].n_turns == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "a")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.n_out) for r in out) == [("1", 1, 1), ("None", 1, 1), ("None", 1, 1), ("None", 1, 1)]


def test_query_keeps_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    convs = spark.read.parquet(f"{sf}/conversations.parquet")
    out = chat.query(spark, sf).collect()
    assert len(out) == convs.select("conv_id").distinct().count()
    by = {}
    for r in convs.distinct().collect():
        by.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn), (r.role is not None, r.role or ""), (r.text is not None, r.text or ""), r.role))
    for r in out:
        assert r.cost == brute([chat.role_of(t[3]) for t in sorted(by[r.conv_id], key=lambda t: t[:3])])


def test_sql_on_odd_conversations(spark):
    """All kinds of roles, nulls, ties and repeats against the SQL twin."""
    import random

    import duckdb
    import pandas as pd

    r = random.Random(11)
    roles = ["system", "user", "assistant", " Human ", "bot", "zzz", "", None]
    rows = [(r.choice([None, *range(60)]), r.choice([None, 0, 1, 2, 3, 4]), r.choice(roles), r.choice([None, "", "a", "b <|x|>", "é\nf"])) for _ in range(500)]
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", pdf)
    cur = con.execute(chat.SQL)
    names = [d[0] for d in cur.description]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*names).collect()
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(x)) for x in got)
