"""The trie against a dictionary of all openings in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cindergrid.llm import conversation_trie as op
from cindergrid.session import cut_lineage

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int")


def graft(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + turns[h:]
    return built


def brute(built):
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(members) - 1) * (len(n[-1][1].encode()) if n else 0)
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest())
                  for n, m in nodes.items())


def result(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def tree(rows, df, **options):
    turns, convs = op.grafted(cut_lineage(op.numbered(df)))
    return op.trie(turns, convs, **options)


def some(n, seed, deepest=9):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b é", None, "", "a:1"])) for c in range(n) for t in range(r.randrange(deepest))]


@pytest.mark.parametrize("height", [2, 8])
def test_all_nodes(spark, height):
    rows = some(60, 5)
    assert result(tree(rows, table(spark, rows), height=height)) == brute(graft(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "gone"), (-7, 1, "user", "b"), (-7, None, "user", "a"), (-5, 0, None, None), (3, 0, "user", "x"), (3, 0, "user", "x"),
            (3, 0, "assistant", "x"), (12, 0, "user", "alone"), (2**40, 5, "user", "w " * 50000)]
    assert result(tree(rows, table(spark, rows))) == brute(graft(rows))


def test_empty(spark):
    assert tree([], table(spark, [])).count() == 0


def test_long_conversations_over_blocks_and_bands(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    monkeypatch.setattr(op, "PIECE", 3)
    rows = [(c, t, "user", f"t{t if t < 150 + c else (t, c)}") for c in range(0, 40, 5) for t in range(200)] + [(c, 0, "user", "same") for c in range(100, 200)]
    assert result(tree(rows, table(spark, rows), height=4)) == brute(graft(rows))


def test_own_openings_without_graft(spark):
    """The operator on conversations as they are."""
    rows = some(30, 8)
    places = cut_lineage(op.numbered(table(spark, rows)))
    built = defaultdict(list)
    for c, turn, role, text in rows:
        built[c].append((role or "", text or ""))
    assert result(op.trie(places, op.lengths(places))) == brute(built)
