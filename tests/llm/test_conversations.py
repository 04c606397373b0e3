import random
import re
import sys
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import types as T

from quantloom.llm import conversation_repair, conversation_trie

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("key", "place", "word", "audit", "p1", "depth", "_id")]])


@pytest.fixture(scope="module")
def talk(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def text_key(role: str, text: str) -> bytes:
    return sha256(f"{len(role)}:{role}{text}".encode()).digest()


def damaged(rows) -> dict:
    """conv_id -> rows after damage in order, by the letter of the contract."""
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], text_key(r[1], r[2])))
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str, str]:
    """Least (cost, audit) and the repaired lines, edit by edit; rows are (role, text, fault)."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i: int, last: str, inserted: int):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            cost, audit, lines = best(i, follow[last], inserted + 1)
            ways.append((cost + 2, "I" + audit, (f"{name[follow[last]]}:", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, last, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                cost, audit, lines = best(i + 1, follow[last], 0)
                ways.append((cost + 2 + extra, "R" + audit, (f"{name[follow[last]]}:{text}", *lines)))
                if role[:1] == follow[last] or (role[:1] == "s" and last == ""):
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    ways.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
        return min(ways, key=lambda w: w[:2], default=(1 << 40, "", ()))

    sys.setrecursionlimit(20_000)
    cost, audit, lines = best(0, "", 0)
    return cost, audit, "\n".join(lines)


def by_hand(rows) -> dict:
    out = {}
    for conv, kept in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(kept, faults)])
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256(lines.encode()).hexdigest())
    return out


def repaired(talk, rows) -> dict:
    found = conversation_repair.op12(talk(rows)).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(out) == len(found)
    return out


def random_rows(seed: int, convs, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "why", "Is it?", "", " \t", None, "One. ", "two. \n", "é.", "Ok. "]
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            said = rng.choice(texts) if rng.random() < 0.3 else f"{rng.choice('abcdefgh')}{rng.randrange(60)}{rng.choice(['.', '!', ''])}"
            rows.append((conv, None if rng.random() < 0.03 else turn, rng.choice(roles[:4]) if rng.random() < 0.7 else rng.choice(roles), said))
    rng.shuffle(rows)
    return rows


def test_repair_equals_edit_by_edit_search(talk):
    rows = random_rows(3, [*range(150), None, -5], 14)
    assert repaired(talk, rows) == by_hand(rows)


@pytest.mark.parametrize("length", [63, 64, 65, 128, 129, 300])
def test_repair_across_blocks(talk, length):
    rng = random.Random(length)
    rows = [(9, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["x.", "cut", f"t{t}.", ""])) for t in range(length)]
    assert repaired(talk, rows) == by_hand(rows)


def test_repair_odd_rows(talk):
    assert conversation_repair.op12(talk([])).collect() == []
    lost = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "gone."), (-1, None, None, None), (-1, None, None, None), (-2, 5, "user", "w " * 200_000 + "."), (-2, 2**40, "assistant", "far.")]
    assert repaired(talk, rows) == by_hand(rows)
    assert repaired(talk, rows)[lost] == (0, 0, 0, 0, 0, 0, "", sha256().hexdigest())
    repeated = [(4, t, r, x) for t, r, x in [(0, "user", "b."), (0, "user", "b."), (0, "assistant", "a."), (1, "user", "b.")]] * 2
    assert repaired(talk, repeated) == by_hand(repeated)


def test_automaton_computes_shared_suffixes_once(monkeypatch):
    made = []
    step = conversation_repair.Automaton.step
    monkeypatch.setattr(conversation_repair.Automaton, "step", staticmethod(lambda letter, below: made.append(letter) or step(letter, below)))
    automaton = conversation_repair.Automaton()
    words = ["ua", "sua", "uaua", "Uaua", "X" + "ua" * 10]
    for word in sorted(words, key=lambda w: w[::-1]):
        automaton.value(word)
    assert len(made) == len({w[i:] for w in words for i in range(len(w))})


# -- prefix trie --------------------------------------------------------------------------------


def trie_by_hand(rows) -> dict:
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for conv in own:
        own[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], text_key(r[1], r[2])))
        own[conv] = [r[1:] for r in own[conv]]
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(donor, [])[:h] + own[c][h:])
    members, ends = {}, {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
        ends.setdefault(said, []).append(c)
    out = {}
    for prefix, convs in members.items():
        inside = [p for p in members if p[: len(prefix)] == prefix]
        childless = [p for p in inside if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in inside)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        listed = ",".join(map(str, sorted(ends.get(prefix, []))))
        out[min(convs), len(prefix)] = (
            min(members[prefix[:-1]]) if prefix else None, len(convs), sum(len(p) == len(prefix) + 1 for p in inside), len(childless), saved, sha256(listed.encode()).hexdigest())
    return out


def nodes_of(talk, rows) -> dict:
    found = conversation_trie.op13(talk(rows)).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(out) == len(found)
    return out


def shared_rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 13)):
            rows.append((c, None if rng.random() < 0.02 else t, rng.choice(["user", None]), "hello" if t == 0 and rng.random() < 0.6 else f"é{rng.randrange(3)}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bound", [1024, 3])
def test_trie_equals_prefix_by_prefix(talk, monkeypatch, bound):
    monkeypatch.setattr(conversation_trie, "MEMBERS", bound)
    monkeypatch.setattr(conversation_trie, "isqrt", lambda n: bound)
    rows = shared_rows(bound, 70)
    assert nodes_of(talk, rows) == trie_by_hand(rows)


def test_trie_odd_rows(talk):
    assert conversation_trie.op13(talk([])).collect() == []
    short = [(c, 0, "user", "x") for c in (7, 11, 13, 16, 22)]  # no donors: some are left without turns
    assert nodes_of(talk, short) == trie_by_hand(short)
    copies = [(c, t, "user", f"t{t}") for c in range(0, 60, 5) for t in range(9)]
    longest = [(100, t, "user", f"t{t}") for t in range(1200)] + [(105, t, "user", f"t{t}") for t in range(700)] + [(101, 0, "user", "b " * 100_000), (None, 0, "user", "x"), (-7, None, None, None), (-7, None, None, None), (-5, 3, "a", "b")]
    assert nodes_of(talk, copies) == trie_by_hand(copies)
    assert {k: v[:5] for k, v in nodes_of(talk, longest[1100:]).items()} == {k: v[:5] for k, v in trie_by_hand(longest[1100:]).items()}


def test_parentheses_against_parents():
    rng = random.Random(2)
    for n in (0, 1, 2, 700, 3000):
        parent = [rng.randrange(-1, i) if rng.random() < 0.9 or not i else i - 1 for i in range(n)]
        tree = conversation_trie.Parentheses(parent)
        assert sorted(tree.order.tolist()) == list(range(n))
        size = [1] * n
        for i in reversed(range(n)):
            if parent[i] >= 0:
                size[parent[i]] += size[i]
        for node, start, end in zip(tree.order.tolist(), tree.opens.tolist(), tree.closes().tolist()):
            assert end - start + 1 == 2 * size[node] and tree.findclose(start) == end
