"""Operator 11 against a trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from noticeloom.llm.prefixtrie import SpillingQueue, dialogue_trie, op11_prefix_trie, pass_upwards, positions, prefix_trie


def sequences(rows):
    """The turns of each dialogue in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved, rows = {}, {}, set()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    for node, who in members.items():
        text = ",".join(map(str, sorted(ends[node])))
        rows.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(text.encode()).hexdigest()))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_corpus(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_prefix_trie(spark, folder)) == trie(rebuilt(sequences(rows)))


@pytest.fixture(scope="module")
def crowd():
    """Dialogues of which half begin alike, with ties, nulls, copies and one that is long."""
    rng, rows = random.Random(2), []
    for c in range(-7, 150):
        start = ["hello"] * rng.randrange(1, 4) if c % 2 else []
        for i, text in enumerate([*start, *(rng.choice("ab") for _ in range(rng.randrange(0, 5)))]):
            rows.append((c, None if rng.random() < 0.1 else i, rng.choice(["user", "user", "bot", None]) if i > 1 else "user", text))
    rows += [(c, i, "user", f"é{i}") for c in (200, 201, 202, 205) for i in range(60)] + [(205, 60, "bot", None)]
    rows += [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (300, 1, "user", "")]
    return rows


def test_shards(spark, crowd):
    turns = spark.createDataFrame(crowd, SCHEMA)
    want = trie(sequences(crowd))
    assert got(dialogue_trie(turns)) == want
    rows = positions(turns, long=20)
    assert got(prefix_trie(rows, turns.select("conv_id"), long=20, band=3, levels=7, most=2)) == want


def test_turnless_members(spark):
    rows = positions(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA))
    members = spark.createDataFrame([(1,), (2,), (None,), (2,)], "conv_id long")
    assert got(prefix_trie(rows, members)) == trie({1: [("user", "a")], 2: []})
    assert got(prefix_trie(rows.limit(0), members.where("conv_id = 2"))) == trie({2: []})


def test_empty_table_and_own_columns(spark):
    assert dialogue_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a", 5, 6, 7)], SCHEMA + ", depth int, key int, digest int")
    assert got(dialogue_trie(odd)) == trie({1: [("user", "a")]})


def test_queue_spills():
    rng, queue, want = random.Random(1), SpillingQueue(10), []
    for i in range(500):
        message = (rng.randrange(50), i, 1, 2)
        queue.push(message)
        want.append(message)
        if i % 3 == 0:
            want.sort()
            assert queue.peek() == want[0] and queue.pop() == want.pop(0)
    assert len(queue.runs) > 3
    assert [queue.pop() for _ in want] == sorted(want) and queue.peek() is None


def test_lost_messages_are_told():
    names = ["conv_id", "depth", "parent_conv_id", "inner", "n_leaves", "saved_tokens"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, (1, 2, 1, True, 1, 0), strict=True))])
    with pytest.raises(ValueError, match="no node"):
        list(pass_upwards([batch]))
