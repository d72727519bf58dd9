"""Conversation repair against an exhaustive search over all edit strings."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from tripcast.llm import common, conversations
from tripcast.llm.conversations import Checkpoints, TERMINAL, back

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, cost double"
STEP = {("0", "u"): "u", ("0", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute(rows):
    """All result columns of one conversation, from its rows after damage."""
    blank = [not re.search(r"[^\x20\x09-\x0D]", t) for _, _, t in rows]
    copy = [(r, t) in [(a, b) for _, a, b in rows[:i]] for i, (_, r, t) in enumerate(rows)]
    cut = [not re.search(r"[.!?][\x20\x09-\x0D]*\Z", t) for _, _, t in rows]

    @functools.cache
    def best(i, state):
        """Least (cost, edits, output lines) from here on."""
        found = []
        if i == len(rows) and state in "0a":
            found.append((0, "", ()))
        for role in "ua":
            if (state, role) in STEP and depth[i] < 2:
                depth[i] += 1
                c, e, o = best.__wrapped__(i, STEP[state, role])
                depth[i] -= 1
                found.append((c + 2, "I" + e, (("user:" if role == "u" else "assistant:"), *o)))
        if i < len(rows):
            _, name, text = rows[i]
            c, e, o = best(i + 1, state)
            found.append((c + 3, "D" + e, o))
            if not blank[i] and not copy[i]:
                for role, new, letter, price in ((name[:1], name, "K", 0), ("u", "user", "R", 2), ("a", "assistant", "R", 2)):
                    if (state, role) in STEP:
                        c, e, o = best(i + 1, STEP[state, role])
                        found.append((c + price + cut[i], letter + e, (f"{new}:{text}", *o)))
        return min(found, default=(10 ** 9, "~", ()))

    depth = [0] * (len(rows) + 1)
    cost, audit, lines = best(0, "0")
    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, sum(blank),
            sum(c and not b for b, c in zip(blank, copy)),
            sum(x and not b and not c for b, c, x in zip(blank, copy, cut)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows, block=conversations.BLOCK, columns="conv_id long, turn long, role string, text string"):
    got = conversations.repair_conversations(spark.createDataFrame(rows, columns), block).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    assert {r.conv_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        assert tuple(r)[1:] == brute(damage(by[r.conv_id])), r.conv_id


def test_every_conversation_of_the_fixture(llm):
    rows = [tuple(r) for r in common.read_table(llm, SF, "conversations").collect()]
    check(llm, rows)


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_random_conversations_cut_into_blocks(llm, block):
    rng = random.Random(7)
    texts = ["Hello there.", "And then", "", "  \t", "yes!", None, "end. \n", "a\x0bb?\x0b"]
    rows = [(c, rng.choice([None, *range(-1, 12)]), rng.choice(["system", "user", "assistant", "tool", "", None, "User"]),
             rng.choice(texts) if rng.random() < .6 else f"t{rng.random()}.")
            for c in [None, *range(60)] for _ in range(rng.randrange(1, 9))]
    check(llm, rows, block)


def test_one_hot_conversation_over_many_blocks_and_tasks(llm):
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", "cut", f"own {t}."])) for t in range(900)]
    got = conversations.repair_conversations(
        llm.createDataFrame(rows + [(6, 1, "user", "x.")], "conv_id long, turn long, role string, text string"), 64).collect()
    one = conversations.repair_conversations(
        llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert next(r for r in got if r.conv_id == 5) == one[0]
    assert len(one[0].audit) >= len(damage(rows))


def test_checkpoints_give_every_vector():
    rng = random.Random(9)
    codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(50))
    made = Checkpoints(codes, TERMINAL)
    assert len(made.kept) <= 9
    vector, want = TERMINAL, {50: TERMINAL}
    for i in range(49, -1, -1):
        want[i] = vector = back(vector, codes[i])
    for i in [*range(51), 3, 40, 7]:
        assert made.at(i) == want[i]


def test_odd_rows(llm):
    assert conversations.repair_conversations(llm.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None, "k", 1.0), (1, 1, "user", "x" * 100000, None, None),
            (2, 2, "user", "a.", None, None), (2, 2, "user", "a.", None, None), (3, None, "assistant", "b", None, None)]
    check(llm, rows, columns=SCHEMA)
