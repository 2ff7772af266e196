"""Repair and prefix trie of conversations against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from veilspark.llm import trie, turns
from veilspark.llm.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPACE = "\x20\x09-\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int"
LINES = ["Yes.", "No!", "Open", "", " \n", "Why? ", "x.\x85"]


def odd_rows(seed=5, n=60):
    """Nulls in every column, ties, repeated rows, empty and long texts, negative ids, and columns named as the operators name theirs."""
    import random

    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, n), None]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            turn = None if rng.random() < 0.1 else t + (t > 3) * 2
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "ann", None])
            text = None if rng.random() < 0.05 else rng.choice(LINES) if rng.random() < 0.7 else "long text " * 3000 + "."
            rows += [(c, turn, role, text, "k", 1)] * rng.choice([1, 1, 1, 2])
    return rows


def read_rows(df):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]


# -- repair -----------------------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain_repair(rows):
    """(cost, audit, turns) by trying all edits from each state of the pattern, forwards."""
    step = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
    best = {0: (0, "", ())}

    def offer(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def grow(table):
        for _ in range(3):
            for state, (cost, audit, kept) in list(table.items()):
                role = "assistant" if state == 2 else "user"
                offer(table, 3 if state == 2 else 2, (cost + 2, audit + "I", (*kept, (role, ""))))

    for role, text, fault in rows:
        grow(best)
        after = {}
        for state, (cost, audit, kept) in best.items():
            offer(after, state, (cost + 3, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            cost += fault == "truncated"
            if state in step.get(role[:1], {}):
                offer(after, step[role[:1]][state], (cost, audit + "K", (*kept, (role, text))))
            for new in ("user", "assistant"):
                if state in step[new[0]]:
                    offer(after, step[new[0]][state], (cost + 2, audit + "R", (*kept, (new, text))))
        best = after
    grow(best)
    return min(v for s, v in best.items() if s in (0, 3))


def plain_conversations(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    groups = {}
    for c, t, role, text in plain_damage(rows):
        groups.setdefault(c, []).append((t, role, text))
    for c, own in groups.items():
        seen, faults = set(), []
        for _, role, text in own:
            words = re.findall(f"[^{SPACE}]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in own if t is not None]
        first = [r[:1] for _, r, _ in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:]))
        cost, audit, kept = plain_repair([(r, x, f) for (_, r, x), f in zip(own, faults)])
        n = Counter(faults)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def repaired(df):
    return {r["conv_id"]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_repair_equals_the_plain_version(spark, sf):
    got = QUERIES["op12_run_length_repair"](spark, sf)
    assert repaired(got) == plain_conversations(read_rows(spark.read.parquet(f"{sf}/conversations.parquet"))) and got.count() == len(repaired(got))


def test_repair_of_odd_rows(spark):
    rows = odd_rows()
    assert repaired(turns.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == plain_conversations([r[:4] for r in rows])
    assert turns.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repair_of_a_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK_BITS", 3)
    rows = [(1, t, "user" if t % 700 > 90 or t % 2 else "assistant", f"turn {t % 1500}" + "." * (t % 5 > 0), "k", 1) for t in range(3000)]
    assert repaired(turns.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain_conversations([r[:4] for r in rows])


def test_runs_jump_by_binary_powers():
    import random

    rng = random.Random(2)
    for _ in range(400):
        letters = "".join(rng.choice("AEFGHIKMP") * rng.choice([1, 1, 2, 7, 40]) for _ in range(rng.randint(1, 6)))
        rows = [("suax"[(ord(x) - 65) // 4], "", ["", "blank", "duplicate", "truncated"][(ord(x) - 65) % 4]) for x in letters]
        cost, edits = turns.repair(letters)
        assert (cost, "".join(edits)) == plain_repair(rows)[:2]


# -- prefix trie ------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    """Nodes by their whole sequences."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns_ in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5) * (1 if c > 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns_[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((c, d == len(whole)))
    children, leaves, saved = Counter(), Counter(), Counter()
    for seq in nodes:
        if seq:
            children[seq[:-1]] += 1
    for seq, members in nodes.items():
        for d in range(len(seq) + 1):
            saved[seq[:d]] += (len(members) - 1) * len(seq[-1][1]) if seq else 0
            leaves[seq[:d]] += not children[seq]
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, end in m if end))).encode()).hexdigest()
    return Counter((min(m)[0], len(s), min(nodes[s[:-1]])[0] if s else None, len(m), children[s], leaves[s], saved[s], ends(m)) for s, m in nodes.items())


def trie_rows(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_trie_equals_the_plain_version(spark, sf):
    assert trie_rows(QUERIES["op13_prefix_trie"](spark, sf)) == plain_trie(read_rows(spark.read.parquet(f"{sf}/conversations.parquet")))


def test_trie_of_odd_rows(spark, monkeypatch):
    rows = odd_rows(7, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_trie([r[:4] for r in rows])
    assert trie_rows(trie.prefix_trie(df)) == want
    monkeypatch.setattr(trie, "_SLICE", 64)  # a sketch so small that it proves little
    monkeypatch.setattr(trie, "FEWEST_CELLS", 64)
    monkeypatch.setattr(trie, "MOST_CELLS", 128)
    assert trie_rows(trie.prefix_trie(df)) == want
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "k", 1)], SCHEMA)).count() == 0


def test_trie_of_copies_and_long_conversations(spark):
    """Hundreds of equal conversations, and long ones that lie in several partitions and share most of their turns."""
    rows = [(c, t, "user", f"same {t}", "k", 1) for c in range(10, 400) for t in range(3)]
    rows += [(c, t, "ua"[t % 2], f"long {t} {'x' * (t % 9)}" + f" {c}" * (t > 600 + c % 7), "k", 1) for c in (1000, 1003, 2001) for t in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie_rows(trie.prefix_trie(df)) == plain_trie_long(rows)


def plain_trie_long(rows):
    """As plain_trie, but with interned prefixes, for long conversations."""
    names, last, nodes = {}, {}, {}
    own = {}
    for c, t, role, text in (r[:4] for r in rows):
        own.setdefault(c, []).append((t, role.encode(), text.encode()))
    own = {c: [r[1:] for r in sorted(v)] for c, v in own.items()}
    parent = {0: None}
    for c, turns_ in own.items():
        h, at = zlib.crc32(str(c).encode()) % 9, 0
        whole = own.get(c - c % 5, [])[:h] + turns_[h:]
        nodes.setdefault(0, []).append((c, not whole))
        for d, turn in enumerate(whole, 1):
            at = names.setdefault((at, turn), len(names) + 1)
            last[at] = turn
            nodes.setdefault(at, []).append((c, d == len(whole)))
    for (up, _), at in names.items():
        parent[at] = up
    children = Counter(parent[n] for n in nodes if n)
    depth, leaves, saved = {}, Counter(), Counter()
    for n in sorted(nodes):
        depth[n] = 0 if n == 0 else depth[parent[n]] + 1
        at, bytes_ = n, (len(nodes[n]) - 1) * len(last[n][1]) if n else 0
        while at is not None:
            saved[at] += bytes_
            leaves[at] += not children[n]
            at = parent[at]
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, end in m if end))).encode()).hexdigest()
    return Counter((min(m)[0], depth[n], min(nodes[parent[n]])[0] if n else None, len(m), children[n], leaves[n], saved[n], ends(m)) for n, m in nodes.items())


def test_op1_query_moves_a_call_behind_the_result_it_names(spark, tmp_path):
    from veilspark.llm.queries import QUERIES

    rows = [(7, 0, "user", "hello"), (7, 1, "assistant", "$call_7_3"), (7, 2, "user", "a"), (7, 3, "assistant", "b"), (7, 4, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: (r["at_turn"], r["step"]) for r in QUERIES["op1_tool_call_linking"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0), 1: (4, 1), 2: (4, 2), 3: (3, 0), 4: (4, 0)}
