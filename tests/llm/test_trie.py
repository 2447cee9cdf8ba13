"""The prefix trie against one built turn by turn in plain Python."""

import hashlib
import random
import zlib

import pytest

from propgraph.llm import prefix_trie, queries

CHATS = "conv_id long, turn long, role string, text string, depth string, conv int, n string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    nodes = [{"parent": None, "depth": 0, "members": [], "ends": [], "chars": 0, "kids": {}}] if own else []
    for c, turns in rebuilt.items():
        at = 0
        nodes[0]["members"].append(c)
        for t in turns:
            if t not in nodes[at]["kids"]:
                nodes[at]["kids"][t] = len(nodes)
                nodes.append({"parent": at, "depth": nodes[at]["depth"] + 1, "members": [], "ends": [], "chars": len(t[1]), "kids": {}})
            at = nodes[at]["kids"][t]
            nodes[at]["members"].append(c)
        nodes[at]["ends"].append(c)
    for x in nodes:
        x["leaves"], x["saved"] = int(not x["kids"]), (len(x["members"]) - 1) * x["chars"]
    for x in sorted(nodes, key=lambda x: -x["depth"]):
        if x["parent"] is not None:
            nodes[x["parent"]]["leaves"] += x["leaves"]
            nodes[x["parent"]]["saved"] += x["saved"]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(x["members"]), x["depth"], -1 if x["parent"] is None else min(nodes[x["parent"]]["members"]), len(x["members"]), len(x["kids"]), x["leaves"], x["saved"], digest(x["ends"])) for x in nodes
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], CHATS)
    out = prefix_trie.trie(*prefix_trie.rebuilt(df)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def test_random_conversations(spark):
    """Few texts, so that conversations share prefixes; nulls, ties, repeated rows, absent bases, turnless and negative ids."""
    rng = random.Random(4)
    rows = []
    for c in [*range(-120, 0, 7), *range(0, 260, 3), *range(1000, 1040), 10**12, 10**12 + 5]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", "", None]), rng.choice(["a", "a", "bé\U0001f600", "", None])))
    rows += [(None, 0, "user", "x"), (None, None, None, None)] + rows[:40]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_shared_conversations(spark):
    """Most conversations are the same, so two nodes hold nearly all ends."""
    rows = [(c, t, "user", "hello there") for c in range(6000) for t in range(2)]
    rows += [(c, t, "user", f"own {c}") for c in range(6000, 6050) for t in range(9)]
    assert found(spark, rows) == brute(rows)


def test_long_conversation(spark, monkeypatch):
    """One conversation has most turns and lies in several partitions; equal rows among them; the trie is as deep as it is long."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 50)
    rows = [(7, t // 2, "user", "same" if t % 5 else f"turn {t}") for t in range(700)] + [(3, 0, "user", "same")] * 400
    rows += [(c, t, "assistant", "x") for c in (100, 101, 102, 250) for t in range(7)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == brute(rows)
    placed = prefix_trie.ordered(spark.createDataFrame([(*r, "x", 1, None) for r in rows], CHATS).repartition(5), "conv_id", "turn", "role", "text")
    assert sorted(r["pos"] for r in placed.where("conv = 7").collect()) == list(range(700))
    assert sorted(r["pos"] for r in placed.where("conv = 3").collect()) == list(range(400))


@pytest.mark.parametrize("table", ["0.001"])
def test_query_on_a_table(spark, table):
    sf = f"/root/testdata/sf{table}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_prefix_trie(spark, sf).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(-1 if x is None else x for x in r) for r in out.collect()) == brute(rows)
