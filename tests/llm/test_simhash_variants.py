"""Fingerprints and components against plain Python over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cindergrid.llm import simhash_variants as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    """rows of (id, fingerprint): the smallest id reachable for each."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    f = np.array([v for _, v in rows], np.uint64)
    for x in range(len(rows)):
        for y in np.flatnonzero(np.bitwise_count(f[x + 1 :] ^ f[x]) <= 3).tolist():
            parent[find(x + 1 + y)] = find(x)
    low = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[find(x)].append(i)
    return [min(low[find(x)], default=None) for x in range(len(rows))]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, fp string, first int")
    fps = [plain(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, groups([(i, f) for (i, _), f in zip(rows, fps)]))]
    assert order(tuple(r) for r in op.near_duplicates(df, **options).collect()) == order(want)


def texts(n, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("ab cd ef gh ij kl mn op Qr st".split()) + str(r.randrange(40)) for _ in range(r.choice([1, 2, 3, 60, 200]))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"new{r.randrange(5)}"
        out.append(r.choice([" ", "\n", "\t "]).join(w))
    return out


def test_components(spark):
    check(spark, list(enumerate(texts(400, 3))))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\x0b"), (None, ""), (4, "one"), (4, "ONE"), (5, "one two"), (None, "alone here now"), (6, "é中\U0001F600 x" * 40),
            (7, " ".join(f"w{i % 977}" for i in range(70000))), (8, "a b c d"), (9, "É é E e")]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("limit", [2048, 20, 2])
def test_hot_keys_lose_no_link(spark, limit):
    """A ball of fingerprints around one centre fills keys of every level; others lie between balls."""
    r = random.Random(9)
    fps = set()
    for centre in (r.getrandbits(64), r.getrandbits(64)):
        for _ in range(250):
            f = centre
            for b in r.sample(range(64), r.randrange(12)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in op.links(df, limit).distinct().collect():
        a, b = a % 2**64, b % 2**64
        assert (a ^ b).bit_count() <= 3
        parent[find(a)] = find(b)
    number = groups([(k, f) for k, f in enumerate(fps)])
    mine = defaultdict(list)
    for k, f in enumerate(fps):
        mine[find(f)].append(k)
    assert sorted(mine.values()) == sorted([k for k in range(len(fps)) if number[k] == low] for low in set(number))
