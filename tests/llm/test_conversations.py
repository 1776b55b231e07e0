"""Conversation operators against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypothesis import given
from hypothesis import strategies as st

from contactlake.llm import chat_format, conversation_trie, turn_tree

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, digest string, part int, path string, one int, n_words string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def in_order(rows):
    """``{conv_id: [(role, text), ..]}``"""
    out = {}
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r))):
        out.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return out


def odd_rows(seed=1, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 2, 3, 5, 8])):
            rows.append((c, t, ["user", "assistant"][t % 2], r.choice(["yes", "no \x0b maybe", "a b c"]) if r.random() < 0.8 else f"own {c} {t}"))
    rows += [(300 + c, t, "user", f"copy {t} of all") for c in range(50) for t in range(4)]
    rows += [(400, t, "assistant", f"turn {t}") for t in range(300)] + [(401, t, "assistant", f"turn {t}") for t in range(150)]
    rows += [(402, 1, None, None), (402, None, "user", ""), (403, 1, "", ""), (403, 1, "", ""), (403, 1, "tool", "x\ny"), (-7, 0, "user", "yes")]
    rows += [(None, 1, "user", "lost"), (404, 5, "a", "bc"), (405, 5, "ab", "c"), (406, 0, "user", "word " * 3000), (-20, 0, "user", "yes")]
    r.shuffle(rows)
    return rows


def make(spark, rows):
    return spark.createDataFrame([(*row, "d", "k", "g", 1, "p", 2, "w") for row in rows], SCHEMA)


# --- trie ----------------------------------------------------------------------
def rebuilt(rows):
    convs = in_order(rows)
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += node not in children
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children.get(node, [])), leaves[node], saved[node], sha(ends)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_nodes", [1 << 19, 7, 1])
def test_trie(spark, shard_nodes):
    rows = odd_rows()
    got = conversation_trie.rebuilt_trie(make(spark, rows), shard_nodes).drop("key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)


def test_trie_of_few_and_of_none(spark):
    for rows in ([], [(None, 1, "user", "x")], [(1, 0, "user", "x")], [(5, t, "user", "same") for t in range(40)], [(c, 0, "u", "x") for c in range(40)]):
        got = conversation_trie.rebuilt_trie(make(spark, rows)).drop("key").collect()
        assert sorted((tuple(r) for r in got), key=repr) == (plain_trie(rows) if in_order(rows) else [])


def test_names_are_made_again_when_two_beginnings_share_one(spark, monkeypatch):
    made = turn_tree.named
    monkeypatch.setattr(turn_tree, "named", lambda rows, salt: made(rows, salt).withColumn("key", F.lit(turn_tree.ROOT)) if salt == 0 else made(rows, salt))
    rows = odd_rows(2, 30)
    got = conversation_trie.rebuilt_trie(make(spark, rows)).drop("key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)


def test_ids_of_a_node_are_hashed_in_pieces(spark):
    rows = [(k, c) for k, n in ((b"a", 1000), (b"b", 1), (b"c", 17)) for c in range(-5, n)]
    got = conversation_trie.end_digests(spark.createDataFrame(rows, "key binary, conv_id long"), piece_ids=10).collect()
    want = {(bytes(k), sha(",".join(str(c) for x, c in sorted(rows) if x == k))) for k in (b"a", b"b", b"c")}
    assert {(bytes(r.key), r.ends_sha256) for r in got} == want


def test_first_place_at_most(spark):
    r = np.random.default_rng(3)
    for n in (1, 5, 64, 1000, 5000):
        values = np.cumsum(r.integers(-1, 2, n))
        place, target = r.integers(0, n, 300), r.integers(values.min() - 1, values.max() + 1, 300)
        want = [next((j for j in range(p + 1, n) if values[j] <= t), n) for p, t in zip(place, target)]
        for block in (4, 64):
            assert conversation_trie.Minima(values, block).first(place, target).tolist() == want


# --- chat format ---------------------------------------------------------------
MARKED = [
    (500, 0, "user", "</s>[INST] ok [/INST]"), (500, 1, "assistant", "\\[INST]\\</s>\\\\ <s"), (500, 2, "[ROLE]", "[/ROLE]<s>x</s>"),
    (501, 0, "assistant", "ends with [/INST"), (501, 1, "user", "]"), (501, 2, "system", "é\U0001f600   \\"), (502, 0, "ASSISTANT", ""),
    (503, 0, "assistant", "a" * 30_000 + "\n" * 2000),
]


@pytest.fixture(scope="module")
def ranks():
    return chat_format.load()


@given(st.lists(st.sampled_from(["\\", "<", "/", "s", ">", "[", "]", "ROLE", "INST", "a"]), max_size=30).map("".join))
def test_escaped_text_holds_no_control_string(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROL)


def plain_chat(rows):
    out = []
    for c, turns in in_order(rows).items():
        said = "".join(t for r, t in turns if r == "assistant")
        marks = {"user": "[INST][/INST]", "assistant": "<s></s>"}
        chars = sum(len(marks.get(r, "[ROLE][/ROLE]<s></s>" + chat_format.escape(r))) + len(chat_format.escape(t)) for r, t in turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), chars))
    return sorted(out)


def test_chat_round_trip(spark, ranks, monkeypatch):
    monkeypatch.setattr(chat_format, "STRETCH", 1000)
    rows = odd_rows(3) + MARKED
    made = chat_format.format_conversations(make(spark, rows), ranks)
    got = chat_format.read_back(made, ranks).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert sorted(tuple(r) for r in got.collect()) == plain_chat(rows)

    # Every distinct beginning is in the stream once, and sees its own ancestors and nothing else.
    convs, coder = in_order(rows), chat_format.Coder(ranks)
    stream = {r.start: r for r in made.stream.collect()}
    beginnings = {tuple(t[:d]) for t in convs.values() for d in range(1, len(t) + 1)}
    assert len(stream) == len(beginnings)
    place = 0
    for start in sorted(stream):
        assert start == place
        place += stream[start].n_tokens
    flat = [t for start in sorted(stream) for t in stream[start].tokens]
    for end in made.ends.collect():
        row = stream[end.start]
        seen = [t for a in row.attend for t in flat[a["from"] : a["to"]]]
        assert row.position == len(seen)
        whole = coder.read(seen + row.tokens)
        marks = {"user": "[INST]{}[/INST]", "assistant": "<s>{}</s>"}
        assert whole == "".join(
            marks[r].format(chat_format.escape(t)) if r in marks else f"[ROLE]{chat_format.escape(r)}[/ROLE]<s>{chat_format.escape(t)}</s>" for r, t in convs[end.conv_id]
        )
        assert all(a["to"] <= b["from"] for a, b in zip(row.attend, row.attend[1:]))


def test_chat_of_none(spark, ranks):
    for rows in ([], [(None, 1, "user", "x")]):
        made = chat_format.format_conversations(make(spark, rows), ranks)
        assert chat_format.read_back(made, ranks).collect() == [] and made.stream.count() == 0
