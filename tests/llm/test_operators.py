"""Small tables with odd rows: each operator against plain Python, a round trip, or held-out accuracy."""

import hashlib
import io
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cindergrid.llm import byte_bpe, chat_format, decision_list, decontaminate, katz, language_id, pii, quality_classifier, warc_zip

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c a b c a b"), (5, "a b c a b c a b"), (6, LONG), (None, "no id # $"), (7, "é中\U0001F600 x" * 40)]


def odd(spark):
    """Nulls, empty and long texts, repeats, and columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1.0, "p", "q") for i, t in ODD], "doc_id long, text string, words string, score double, lang string, source string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, words string, score double, lang string, source string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


def base_statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1} if len(windows) < 2000 else None
    covered = None if many is None else len({j for i, x in enumerate(windows) if x in many for j in (i, i + 1, i + 2)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), covered


def test_statistics(spark):
    texts = [t for _, t in ODD] + ["x y z\nx y z\n\nx y z | < > !", "q " * 300, " ".join(map(str, [*range(40), *range(40), *range(17)]))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decision_list.statistics(df).collect():
        want = base_statistics(texts[r.id])
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got[:4] == want[:4] and want[4] in (None, got[4])


def test_rules_are_learned_and_odd_rows_judged(spark):
    rows = [(i, " ".join(f"w{i}x{j}" + ("#" if i % 3 == 0 else "") for j in range(80))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out, rules = decision_list.judge(df, labels(spark, [(i, int(i % 3 > 0)) for i in range(60)]))
    assert rules and all(r.kept == (r.doc_id % 3 > 0) for r in out.collect())
    out, rules = decision_list.judge(odd(spark), labels(spark))
    assert not rules and out.count() == len(ODD)
    assert decision_list.judge(empty(spark), labels(spark))[0].count() == 0


def test_quality_follows_labels_and_shrinks_sites(spark):
    rows = [(i, " ".join((f"good{i}w{j}" if i % 4 else f"BAD!{j}$$") for j in range(60)), f"s{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality_classifier.classify(df, labels(spark, [(i, int(i % 4 > 0)) for i in range(0, 120, 2)]), F.col("source"), F.lit("x")).collect()
    assert len(found) == 120 and all(r.kept == (r.doc_id % 4 > 0) for r in found)
    site = (F.col("source"), F.col("lang"))
    assert all(r.kept for r in quality_classifier.classify(odd(spark), labels(spark), *site).collect())
    assert quality_classifier.keep(odd(spark), labels(spark), *site).columns == odd(spark).columns
    assert quality_classifier.classify(empty(spark), labels(spark), *site).count() == 0


def test_pii_base_spans_and_tagger(spark, folder):
    texts = ["mail a.b@c.de now", "ip 1.2.3.4.5.6.7.8 and 999.1.1.1", "card 4111 1111 1111 1111", "call +49 (30) 1234-567", None, "", "9" * 5000, "@" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tagger = pii.train(docs)
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.base] for r in pii.find(df, tagger).collect()}
    assert got[0] == [("email", "a.b@c.de")] and got[1] == [("ip", "1.2.3.4"), ("ip", "5.6.7.8")]
    assert got[2] == [("card", "4111 1111 1111 1111")] and got[3] == [("phone", "+49 (30) 1234-567")] and got[4] == got[5] == []
    masked = {r.doc_id: r.text for r in pii.redact(df, tagger).collect()}
    assert masked[0] == "mail <email> now" and masked[4] is None and masked[5] == ""
    texts = [r.text for r in docs.collect()]
    bases = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(tagger, texts, [[] for _ in texts], 0.5)
    total = sum(map(len, bases))
    assert sum(b in a for a, bs in zip(alone, bases) for b in bs) >= 0.8 * total
    assert pii.find(empty(spark), tagger).count() == 0 and pii.redact(odd(spark), tagger).count() == len(ODD)


def test_gradient_of_the_tagger():
    random = np.random.default_rng(1)
    tagger = pii.Tagger()
    ids, tags = random.integers(0, 90, (3, 9)), np.array([[0, 1, 2, 2, 0, 3, 4, 0, 0]] * 3)
    _, g = tagger.gradient(ids, tags)
    for name in ("out", "wf", "wb", "move", "vec"):
        flat = tagger.p[name].reshape(-1)
        for at in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            kept = flat[at]
            values = []
            for step in (1e-5, -1e-5):
                flat[at] = kept + step
                values.append(tagger.gradient(ids, tags)[0])
            flat[at] = kept
            assert abs((values[0] - values[1]) / 2e-5 - g[name].reshape(-1)[at]) < 1e-4


def test_training_windows_are_drawn_from_all_texts():
    texts = [f"{chr(65 + i // 10)} call +49 30 {1000000 + i} or write to a{i}@b.de" for i in range(260)]
    ids, tags = pii.training_windows(texts, 200)
    late = {pii.codes(c)[0] for c in "UVWXYZ"}
    assert ids.shape == tags.shape == (200, pii.WIDTH) and late & set(ids[:, 0].tolist()) and tags.any()
    assert len(pii.training_windows(texts[:2], 200)[0]) < 200 and pii.training_windows([])[0].shape == (0, pii.WIDTH)


def test_candidates_longer_than_windows_are_kept_whole():
    """A tagger that takes every run of characters but tildes for an address."""
    class Runs:
        def decode(self, ids):
            inside = (ids != ord("~") - 30) & (ids != 0)
            first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
            return np.where(first, 1, np.where(inside, 2, 0)), np.ones(ids.shape)

    random = np.random.default_rng(3)
    texts = ["~" * 50 + "firstname.lastname @ department.university.edu" + "~" * 50, "7" * 5000, "~" + "7" * 300 + "~~" + "8" * 33 + "~" * 90,
             "~" * 70 + "x" * 200 + "@" + "y" * 150 + "~" * 70, "~no cue~", ""]
    texts += ["~".join("5" * int(n) for n in random.integers(6, 150, 20)) for _ in range(10)]
    want = [[("email", m.start(), m.end()) for m in re.finditer("[^~]+", t)] if re.search("[0-9@]", t) else [] for t in texts]
    assert pii.added_spans(Runs(), texts, [[] for _ in texts], 0.5) == want


def test_reconcile_takes_the_best_disjoint_set():
    assert pii.reconcile([(0, 10, 0, 5.0), (8, 20, 1, 6.0), (20, 30, 2, 1.0), (25, 40, 3, 9.0)], [("ip", 38, 39)]) == [("ip", 8, 20), ("card", 20, 30)]


def test_chat_layouts_escapes_and_odd_turns(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\|x", "<", "[\\", "<|im_end|>\n<|im_start|>user", "\\<\\\\|", ""]
    rows = [(1, i, "assistant" if i % 2 else "user\n%0A", t) for i, t in enumerate(nasty)]
    df = spark.createDataFrame(rows, "c long, n long, role string, text string").select("c", "n", F.to_json(F.struct("role", "text")).alias("p"))
    read = chat_format.read_turns(chat_format.format_turns(chat_format.canonical_turns(df, "p")))
    assert sorted((r.n, r.read_role, r.read_text) for r in read.collect()) == [(n, role, t) for _, n, role, t in rows]
    for r in read.collect():
        inner = r.formatted[len(chat_format.HEAD) : -len(chat_format.FOOT)]
        assert not re.search(r"<\||</s>|\[/?INST\]", inner)
    loss = "".join(t for i, t in enumerate(nasty) if i % 2)
    (d,) = chat_format.digests(read, "c", ["n"]).collect()
    assert (d.n_turns, d.loss_chars, d.loss_sha256) == (7, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    others = [('{"instruction":"a","output":"b"}', [("user", "a"), ("assistant", "b")]), ('{"output":"b","instruction":7}', [("user", "7"), ("assistant", "b")]),
              ('{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}', [("user", "x"), ("assistant", "y")]),
              ('{"messages":[{"role":"system","content":"s"}]}', [("system", "s")]), ('{"what":1}', [(None, None)]), ("no json", [(None, None)]), (None, [(None, None)])]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(others)], "i long, p string")
    got = {}
    for r in sorted(chat_format.canonical_turns(df, "p").collect(), key=lambda r: (r.i, r.position)):
        got.setdefault(r.i, []).append((r.role, r.text))
    assert [got[i] for i in range(len(others))] == [want for _, want in others]


@pytest.mark.parametrize("wide", [False, True])
def test_zip_round_trip(spark, wide, tmp_path):
    same = "<p>" + "x" * 200
    rows = [(3, "http://a", same), (1, None, same), (2, "http://b", "short"), (4, "", "short"), (5, "u", None), (6, "u", "é" * 70000), (None, "u", "lost")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page: r for r in warc_zip.round_trip(df, wide=wide).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for page, _, html in rows[:-1]:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and {got[p].record_type for p in (1, 2, 4, 5, 6)} == {"response"}
    assert warc_zip.round_trip(spark.createDataFrame([], df.schema)).count() == 0
    stream = io.BytesIO()
    package = warc_zip.ZipWriter(stream, wide)
    package.begin("a")
    package.write(b"12345")
    package.end()
    package.close()
    assert zipfile.ZipFile(stream).read("a") == b"12345"


def test_other_archives_are_read_or_refused():
    for method, ok in ((zipfile.ZIP_STORED, True), (zipfile.ZIP_DEFLATED, False)):
        stream = io.BytesIO()
        with zipfile.ZipFile(stream, "w", method) as z:
            z.writestr("m", b"abc" * 100)
        reader = warc_zip.ZipReader(pa.BufferReader(stream.getvalue()))
        if ok:
            assert reader.read("m", 3, 3) == b"abc"
        else:
            with pytest.raises(ValueError):
                reader.read("m")


def test_decontamination(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    items = [(r.item_id, WORD.findall(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = WORD.findall(r.text)
        text = " " + " ".join(w) + " "
        want |= {(r.doc_id, i) for i, x in items if " " + " ".join(x) + " " in text}
    found = decontaminate.find(docs, bench).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in found}
    assert {(r.doc_id, r.item_id) for r in found if r.similarity == 1} == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in found}


def test_decontamination_finds_all_near_copies():
    """Items with a run or scattered words replaced, against brute force over all windows."""
    random = np.random.default_rng(8)
    lost = []
    for n, edits in ((20, 1), (59, 2), (100, 6), (200, 17), (400, 38), (1000, 104)) * 4 + ((60, -1), (200, -6)) * 4:
        item = random.integers(0, 300, n).astype(np.uint64)
        near = item.copy()
        places = np.arange(edits) + random.integers(0, n - edits) if edits > 0 else random.choice(n, -edits, replace=False)
        near[places] = 10**6 + np.arange(len(places), dtype=np.uint64)
        text = np.concatenate([random.integers(2000, 3000, 20).astype(np.uint64), near, random.integers(2000, 3000, 20).astype(np.uint64)])
        words = [(7, " ".join(f"w{x}" for x in item)), (8, " ".join(f"u{x}" for x in range(n)))]
        index = decontaminate.Index(words, 0.8, 5)
        column = pa.array(["x y", " ".join(f"w{x}" for x in text), None, " ".join(f"w{x}" for x in near[: n - 1])])
        got = {(r, i): (j, s, m) for r, i, j, s, m in decontaminate._matches(index, column)}
        for row, own in ((1, text), (3, near[: n - 1])):
            all_windows = [(decontaminate.similarity(own[s : s + n], item, 5), -s) for s in range(len(own) - 4)]
            j, s = max(all_windows)
            if j >= 0.8:
                assert (row, 7) in got or lost.append((n, j)) is None
                assert (row, 7) not in got or abs(got[row, 7][0] - j) < 1e-9 and got[row, 7][1:] == (-s, min(n, len(own) + s))
            else:
                assert (row, 7) not in got
        assert all(i == 7 for _, i in got)
    assert not lost


def test_decontamination_of_many_items_of_one_size(monkeypatch):
    """5,000 items of 19 words and a text of 20,000 words: bounded memory, and the same matches in smaller pieces."""
    import tracemalloc

    random = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(random.choice(words, 19))) for i in range(5000)]
    near = items[11][1].rsplit(" ", 1)[0] + " other"
    column = pa.array([" ".join([*random.choice(words, 20000), items[7][1], near]), items[9][1], None])
    index = decontaminate.Index(items, 0.8, 5)
    tracemalloc.start()
    found = sorted(decontaminate._matches(index, column))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert {(r, i) for r, i, *_ in found} == {(0, 7), (0, 11), (1, 9)}
    monkeypatch.setattr(decontaminate, "PIECE", 100)
    assert sorted(decontaminate._matches(index, column)) == found


def test_fingerprint_candidates_are_all_near_items():
    random = np.random.default_rng(6)
    prints, found = random.integers(0, 2**64, 300, dtype=np.uint64), random.integers(0, 2**64, 400, dtype=np.uint64)
    found[:300] = prints ^ np.uint64(0b101 << 30)
    got = set()
    for which, item in decontaminate._candidates(decontaminate._slots(prints, 4, decontaminate._near()), found):
        got |= set(zip(which.tolist(), item.tolist()))
    far = np.bitwise_count(found[:, None].view(np.uint16).reshape(400, 1, 4) ^ prints[:, None].view(np.uint16).reshape(1, 300, 4))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far.min(axis=2) <= decontaminate.RADIUS // 4))))


def test_rules_are_not_limited_in_number(spark):
    """Twelve kinds of bad rows, each a narrow range of one statistic, need more than eight rules."""
    rows = [(int(k % 10 == 3), *([float(k * 100)] + [1.0] * (len(decision_list.FEATURES) - 1))) for k in range(120) for _ in range(6)]
    df = spark.createDataFrame(rows, "bad int, " + ", ".join(f"{c} double" for c in decision_list.FEATURES))
    rules = decision_list.learn(df, cuts=130)
    kept, _ = decision_list.verdict(rules)
    assert len(rules) > 8 and df.where((F.col("bad") == 1) & kept).count() == 0 == df.where((F.col("bad") == 0) & ~kept).count()
    assert len(decision_list.learn(df, cuts=130, most_rules=2)) == 2


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, LONG[:4000]), (5, "a b c a b c a b")], "item_id long, text string")
    got = sorted({(r.doc_id, r.item_id) for r in decontaminate.find(odd(spark), bench).collect()}, key=str)
    assert got == [(4, 1), (5, 5), (6, 4)]
    assert decontaminate.find(empty(spark), bench).count() == 0 and decontaminate.clean(odd(spark), bench.limit(0)).count() == len(ODD)


def test_bpe_like_the_library(spark, path):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    random = np.random.default_rng(4)
    signs = list("ab'stremvld  \n\t 　\x1c\x851,9é") + ["\U0001F600"]
    texts = [t for _, t in ODD] + ["".join(random.choice(signs, 30)) for _ in range(300)] + ["x" * 4000, "'", "ab'll've"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.decode(byte_bpe.encode(df, path), path).collect():
        text = texts[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert byte_bpe.encode(empty(spark), path).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = out.collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    got = [r for r in language_id.identify(odd(spark), F.lit(False)).collect()]
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert language_id.identify(empty(spark), F.lit(False)).count() == 0


def test_katz_sums_to_one_and_counts_exactly(spark):
    rows = [(i, " ".join(f"t{(i * j * j) % 11}" for j in range(1, 30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(df, held()).collect()}
    train = [WORD.findall(t) + [""] for i, t in rows if not got[i].held_out]
    from collections import Counter

    count = Counter(x for t in train for x in t)
    total = sum(count.values())
    for i, t in rows:
        tokens = WORD.findall(t) + [""]
        base = sum(np.log10((count[x] + 0.5) / (total + 0.5 * (len(count) + 1))) for x in tokens)
        assert got[i].train_tokens == total and got[i].n_tokens == len(tokens) and abs(got[i].base_score - base) < 1e-9
    # Chances of all one-word texts: first word, then the end; with the unknown word they sum to one over first words.
    words = sorted(w for w in count if w)
    probe = spark.createDataFrame([*rows, *((10**6 + k, w) for k, w in enumerate([*words, "unseen"]))], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in katz.score(probe, held() | (F.col("doc_id") >= 10**6)).collect()}
    assert all(np.isfinite(s) for s in scores.values())
    assert katz.score(odd(spark), held()).count() == len(ODD) and katz.score(empty(spark), held()).count() == 0


def test_katz_like_brute_force_with_pairs_seen_once(spark):
    """Every seen pair has its discounted chance, the rest shares what the discounts leave."""
    from collections import Counter

    random = np.random.default_rng(12)
    rows = [(i, " ".join(f"v{int(k)}" for k in random.zipf(1.4, random.integers(1, 25)) if k < 400)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(df, held()).collect()}
    tokens = {i: ["<start>", *WORD.findall(t), "</end>"] for i, t in rows}
    train = [tokens[i] for i, _ in rows if not got[i].held_out]
    word, pair, context = (Counter() for _ in range(3))
    for t in train:
        word.update(t[1:])
        pair.update(zip(t, t[1:]))
        context.update(t[:-1])

    def discount(counts):
        of = Counter(counts.values())
        return katz.discounts(np.array([of[r] for r in range(1, 32)]), 5)[np.minimum(np.arange(max(counts.values()) + 1), 6)]

    d1, d2, total = discount(word), discount(pair), sum(word.values())
    single = {w: d1[c] * c / total for w, c in word.items()}
    unknown = 1 - sum(single.values())

    def chance(h, w):
        if pair[h, w]:
            return d2[pair[h, w]] * pair[h, w] / seen[h][2]
        mass, lower, c = seen.get(h, (0, 0, 1))
        return (1 - mass / c) / (1 - lower) * single.get(w, unknown)

    seen = {}
    for h, c in context.items():
        after = [w for g, w in pair if g == h]
        mass = sum(d2[pair[h, w]] * pair[h, w] for w in after)
        seen[h] = mass, sum(single[w] for w in after), c + (c - mass < 1e-9)
    assert sum(n == 1 for n in pair.values()) > 0.3 * len(pair)
    for h in [*context, "unseen"]:
        assert abs(sum(chance(h, w) for w in [*word, "unseen"]) - 1) < 1e-9
    for i, _ in rows:
        assert abs(got[i].score - sum(np.log10(chance(h, w)) for h, w in zip(tokens[i], tokens[i][1:]))) < 1e-6


def test_katz_discounts_and_normalisation():
    d = katz.discounts(np.array([100, 40, 22, 14, 10, 7, 5] + [0] * 24), 5)
    assert ((0 < d[1:6]) & (d[1:6] < 1)).all() and d[6] == 1
    assert (katz.discounts(np.zeros(31, int), 5)[1:6] < 1).all()


def planted(texts, seed=11):
    """Texts with one span each that no pattern finds whole: spaced at signs, cards and phones with dots or slashes; and
    numbers that fail the check sum as decoys. Returns texts and wanted spans."""
    random = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, random.integers(0, 10, n)))
    out, want = [], []
    for i, text in enumerate(texts):
        sep = str(random.choice([".", "/"]))
        if i % 3 == 0:
            kind, span = "email", f"{''.join(random.choice(list('aeinrst'), 5))}{digits(2)} @ example{digits(1)}.com"
        elif i % 3 == 1:
            kind, span = "card", pii.with_check(sep.join(digits(4) for _ in range(4)))
        else:
            kind, span = "phone", f"+{random.integers(1, 99)}{sep}{digits(3)}{sep}{digits(4)}"
        decoy = digits(16)
        while pii.luhn(decoy):
            decoy = digits(16)
        at = text.find(" ", len(text) // 2) + 1
        out.append(f"{text[:at]}{span} {text[at:]} {decoy} end")
        want.append((kind, at, at + len(span)))
    return out, want


def test_pii_added_spans_keep_the_rules_and_find_planted_variants(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = pii.train(docs.where("doc_id % 2 = 0"))
    plain = [r.text for r in docs.where("doc_id % 2 = 1 and n_chars between 200 and 2000 and not text rlike '[0-9@]'").orderBy("doc_id").limit(300).collect()]
    texts, want = planted(plain)
    bases = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(tagger, texts, bases, 0.5, pii.plausible)
    close = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 1
    # A phone whose dots a base pattern takes as its own is found already.
    right = sum(any(close(s, w) for s in [*a, *b]) for a, b, w in zip(added, bases, want))
    false = sum(not (s[1] < w[2] and w[1] < s[2]) for a, w in zip(added, want) for s in a)
    total = sum(map(len, added))
    assert right >= 0.9 * len(texts) and total - false >= 0.9 * total, (right, len(texts), false, total)
    assert all(pii.plausible(k, t[a:b]) for t, s in zip(texts, added) for k, a, b in s)
    assert not pii.plausible("card", "1234567812345678") and pii.plausible("card", "4111/1111/1111/1111") and not pii.plausible("ip", "1.2.3.256")


def test_toxic_words_are_learned_and_rates_spare_long_texts(spark):
    random = np.random.default_rng(4)
    word = lambda: "w" + "".join(random.choice(list("abcdef"), 3))
    rows = []
    for i in range(300):
        toxic = i % 5 == 0
        w = [word() for _ in range(60)]
        if toxic:
            for j in random.integers(0, 60, 3):
                w[j] = str(random.choice(["Nasty!", "vile,", "NASTY"]))
        rows.append((i, " ".join(w), "s", int(toxic)))
    passage = " ".join(["copied", *(word() for _ in range(30))])
    rows += [(300 + i, passage, "s", 1) for i in range(40)]
    held_out = [(400, "a vile and nasty thing", 1), (401, "copied thing here", 0), (402, " ".join(word() for _ in range(4000)) + " vile", 0), (403, None, 0), (404, "", 0)]
    texts = [(i, t, s) for i, t, s, _ in rows] + [(i, t, "s") for i, t, _ in held_out]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    known = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(df, known, F.col("source"), F.lit("x")).collect()}
    assert all(got[i].kept == (not y) for i, _, _, y in rows if i < 300)
    assert all(got[i].kept == (not y) for i, _, y in held_out)
    kept = {r.doc_id for r in quality_classifier.keep(df, known, F.col("source"), F.lit("x")).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
