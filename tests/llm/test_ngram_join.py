"""The join against all pairs compared in plain Python."""

import re
from collections import defaultdict

from cindergrid.llm import ngram_join as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    rows = [(i, frozenset(shingles(t))) for i, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            a, b = rows[x][1], rows[y][1]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[x] += 1
                links[y] += 1
                parent[find(y)] = find(x)
    group, same = defaultdict(list), defaultdict(list)
    for x, (i, s) in enumerate(rows):
        group[find(x)].append(i)
        same[s].append(i)
    return sorted((i, min(same[s]) if s else None, min(group[find(x)]), links[x]) for x, (i, s) in enumerate(rows))


def result(df):
    return sorted((r.doc_id, r.class_id, r.group_id, r.n_links) for r in df.collect())


def test_whole_table_like_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert result(op.ngram_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_of_near_copies_over_many_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: i % 7 + 40] + [f"x{i % 5}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op.ngram_join(df, volume=200)) == brute(rows)


def test_null_empty_short_long_repeated_and_clashing_columns(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "two words", "c"), (5, "two  words", "c"), (6, long, "d"),
            (7, long + " end", "d"), (8, "two other", "e")]
    df = spark.createDataFrame(rows + [(6, long, "d")], "doc_id long, text string, digest string")
    got = result(op.ngram_join(df))
    assert got == [(1, None, 1, 0), (2, None, 2, 0), (3, None, 3, 0), (4, 4, 4, 1), (5, 4, 4, 1), (6, 6, 6, 2), (6, 6, 6, 2),
                   (7, 7, 6, 2), (8, 8, 8, 0)]
    lost = spark.createDataFrame([(None, "two words"), (9, "two words")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id) for r in op.ngram_join(lost).collect()) == [(0, 9), (9, 9)]


def test_empty_table(spark):
    assert op.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_short_nearly_equal_texts(spark):
    """Blocks are bounded in sets too: links of 3,000 texts of one pattern stay within memory and equal brute force."""
    import tracemalloc

    import numpy as np

    random = np.random.default_rng(3)
    a, b = ([np.unique(random.integers(0, 12, 6)).astype(np.uint64) for _ in range(1500)] for _ in range(2))
    tracemalloc.start()
    x, y, _ = op._links(a, b, 0.8, False)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    sets = [[frozenset(s.tolist()) for s in side] for side in (a, b)]
    got = set(zip(x.tolist(), y.tolist()))
    assert all(((i, j) in got) == (len(s & t) >= 0.8 * len(s | t)) for i, s in enumerate(sets[0][:100]) for j, t in enumerate(sets[1]))
    rows = [(i, f"page {i % 40} not {i // 40} found here at all today") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op.ngram_join(df, most=16)) == brute(rows)


def tasks(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, getattr(spark._jvm.scala, "Array").emptyDoubleArray(), None)
    return sum(stages.apply(i).numCompleteTasks() for i in range(stages.size()))


def test_few_edges_take_few_tasks(spark):
    """The driver keeps an account of every task; a handful of edges needs no task for every shuffle partition."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(20, 21)], "a long, b long")
    settings = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        before = tasks(spark)
        got = {r.v: r.root for r in op.components(edges).collect()}
        taken = tasks(spark) - before
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 21: 20}
    assert taken < 700
