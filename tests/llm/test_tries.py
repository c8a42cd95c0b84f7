"""op11: nodes against a plain trie, with one block and with many levels of blocks."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from slidegrid.llm import tries as T

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth long, ref string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", -1, "r") for r in rows], SCHEMA)


def digest(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[:16]


def own_turns(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            own[c].append(((t is not None, t or 0), digest(said), said))
    return {c: [s for _, _, s in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for j in range(len(p) + 1):
            leaves[p[:j]] += kids[p] == 0
            saved[p[:j]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "café \U0001F600", "a:b"]
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(1, 6))]


AWKWARD = [
    (None, 0, "user", "lost"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (5, 3, "1:a", ""), (6, 1, "1", ":a"), (6, 1, "1:", "a"),
    (-105, 0, "u", "below zero"), (-100, 0, "u", "base"), (200, 0, "u", "x" * 100_000), (201, 2, "u", "x"), (201, 1, "u", "x" * 100_000), (999, 7, "u", "one turn"),
] + [(c, t, "u", f"same {t}") for c in range(300, 345) for t in range(4)] + [(400, t, "u", "long" if t % 3 else "talk") for t in range(700)] + [
    (401, t, "u", "long" if t % 3 else "talk") for t in range(690)]


@pytest.mark.parametrize("block", [T.BLOCK, 7])
def test_nodes_equal_a_plain_trie(spark, block):
    for rows in (AWKWARD, random_rows(3, 90)):
        turns = frame(spark, rows)
        assert got(T.prefix_trie(turns, block)) == plain(own_turns(rows))
        assert got(T.rebuilt_trie(turns, block=block)) == plain(rebuilt(own_turns(rows)))


def test_no_conversations(spark):
    assert T.rebuilt_trie(frame(spark, [])).count() == 0
    assert T.rebuilt_trie(frame(spark, [(None, 1, "u", "t")])).count() == 0
    turnless = [(1, 0, "u", "short")]  # its turns lie before h, and conversation 0 is absent
    assert zlib.crc32(b"1") % 6 >= 1
    assert got(T.rebuilt_trie(frame(spark, turnless))) == plain({1: []})


def test_every_border_is_crossed(spark):
    """One sequence in all blocks, and sequences that are prefixes of each other."""
    rows = [(c, t, "u", "same") for c in range(60) for t in range(3)] + [(100 + n, t, "u", "same") for n in range(20) for t in range(n)]
    assert got(T.prefix_trie(frame(spark, rows), 5)) == plain(own_turns(rows))


def test_shared_turns():
    a = bytes(range(256)) * 100
    for n in (0, 1, 2, 3, 7, 8, 100, 1599, 1600):
        b = a[:16 * n] + b"\xff" * 16
        assert T._shared(a, b) == T._shared(b, a) == n
    assert T._shared(a, a[:-16]) == 1599 and T._shared(b"", a) == 0
