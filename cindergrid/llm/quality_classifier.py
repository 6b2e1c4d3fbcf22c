"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. A logistic regression on whole-text statistics gives each document a log-likelihood ratio of good against bad. It is
   fitted on at most about ``fit_rows`` labelled rows, chosen by a hash of their id; all else covers all documents.
2. The soft evidence of all documents is summed per path and host (partial sums before the shuffle, so a host with a third
   of all rows is a few rows). The spread between hosts, beyond what their sizes explain, gives the strength of a Beta
   prior (method of moments): hosts shrink toward the global mean, paths toward their host.
3. A document's posterior log odds are its ratio plus the log odds of its path without the document itself.
4. Where the labels say which documents are toxic, words that mark them are learned from the same bounded draw (``marks``).
   How often they occur in a document for its length, and the share of toxic documents, give its chance to be toxic.

A document is rejected when its posterior chance to be good is below ``cut`` or its chance to be toxic is at least ``cut``. Null
and empty texts have no statistics; their evidence is what the fit says of such texts, and they are not toxic. Rows without host (path) take the global (host's) mean. Null ids and repeated
rows are scored row by row; repeated labels of one id count once, as their smallest. Without labels of both kinds
all evidence is 0 and quality rejects no row; without a column of toxic labels, or one that marks no word, toxicity is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cindergrid.llm import arrays, sharing
from cindergrid.session import cut_lineage

#: Kinds of bytes: lower case, upper case, digit, blank, line end, symbol, bar or bracket, end of sentence, comma, other sign, non-ASCII.
KINDS = 11
KIND = np.full(256, 9, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 10
for _kind, _signs in ((3, b" \t\v\f\r"), (4, b"\n"), (5, b"#*$%&@^~_"), (6, b"|<>{}[]"), (7, b".!?"), (8, b",;:")):
    KIND[list(_signs)] = _kind
FEATURES = KINDS * KINDS + 5
#: Words of the toxic marks: letters, lower case where ASCII; other ASCII bytes part them.
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def features(column) -> np.ndarray:
    """Statistics of every row: square roots of the shares of pairs of adjacent byte kinds, log length, mean word length,
    shares of distinct words and of distinct three-word windows, share of exclamation marks."""
    out = []
    for _, _, data, offsets in arrays.slices(column):
        rows = len(offsets) - 1
        size = np.diff(offsets)
        kind = KIND[data].astype(np.int32)
        owner = np.repeat(np.arange(rows, dtype=np.int32), size)
        pair = owner[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        pair = pair[owner[1:] == owner[:-1]]
        share = np.bincount(pair, minlength=rows * KINDS * KINDS).reshape(rows, -1) / np.maximum(size - 1, 1)[:, None]
        starts, ends, first = arrays.words(data, offsets)
        h = arrays.hashes(data, starts, ends)
        n = np.diff(first)
        shout = np.bincount(owner[data == 33], minlength=rows) / np.maximum(size, 1)
        length = np.add.reduceat(np.append(ends - starts, 0), np.minimum(first[:-1], len(starts))) * (n > 0) if len(starts) else n
        own = np.array([[len(arrays.distinct(h[a:b])), len(arrays.distinct(arrays.windows(h[a:b], 3)))] for a, b in zip(first[:-1], first[1:])], float)
        out.append(np.column_stack([np.sqrt(share), np.log1p(n), length / np.maximum(n, 1) / 8, own[:, 0] / np.maximum(n, 1),
                                    own[:, 1] / np.maximum(n - 2, 1), np.sqrt(shout)]))
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (last: constant), means and scales of a ridge logistic regression, by Newton steps; the constant is that
    of balanced classes, so that the score is a log-likelihood ratio."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.ones((len(x), x.shape[1] + 1))
    np.subtract(x, mean, out=z[:, :-1])
    z[:, :-1] /= scale
    weighted = np.empty_like(z)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        np.multiply(z, (p * (1 - p))[:, None], out=weighted)
        step = np.linalg.solve(weighted.T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    share = y.mean()
    w[-1] -= np.log(share / (1 - share))
    return w, mean, scale


def drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """Label and text (y, text) of about ``fit_rows`` labelled rows at most."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).cast("int").alias("y"))
    known = known.withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30))
    total = known.count()
    chosen = known.where(F.col("draw") < fit_rows / max(total, 1)).select("id", "y")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), "id").select("y", "text")  # about fit_rows ids at most


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int):
    """The fitted model, or None without labels of both kinds."""
    rows = drawn(docs, labels, id_col, text_col, label_col, fit_rows)

    def run(batches):
        for batch in batches:
            x = features(batch.column(1)).astype(np.float32)
            yield pa.record_batch([batch.column(0), arrays.binary([r.tobytes() for r in x])], ["y", "x"])

    sample = rows.mapInArrow(run, "y int, x binary").toArrow()
    y = np.asarray(sample.column("y"), float)
    if len(np.unique(y)) < 2:
        return None
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(len(y), FEATURES)
    order = np.lexsort((y, *x.T[:3]))
    x = x[order].astype(float)
    del sample
    model = fit(x, y[order])
    del x
    arrays.give_back()
    return model


def letter_words(column):
    """For runs of rows: their first row, the hash of every word of letters, and each row's first word."""
    for start, _, data, offsets in arrays.slices(column):
        plain = LETTER[data]
        starts, ends, first = arrays.words(plain, offsets)
        yield start, arrays.hashes(plain, starts, ends), first


def lower_bound(a: np.ndarray, n: np.ndarray, z: float) -> np.ndarray:
    """Lower end of Wilson's interval of a share: ``a`` of ``n``, ``z`` standard deviations."""
    p = a / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def marks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, z: float = 3.0):
    """Words that mark toxic documents: their sorted hashes, the log of each one's rate among the words of toxic documents
    over that of others, the excess of their rates in toxic documents, and the prior log odds; None where there are none.

    A word counts as often as it has different texts or different neighbouring words in toxic documents, whichever is
    less, so copies of one passage count about once; in other documents every row with it counts. It is a mark when the
    lower bound of its toxic share, ``z`` standard deviations, is above a half: ten documents and no other, at least.
    """
    spark = docs.sparkSession
    rows = cut_lineage(drawn(docs, labels, id_col, text_col, label_col, fit_rows))
    size = {r.toxic: r.n for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None

    def contexts(batches):
        for batch in batches:
            own = np.asarray(batch.column(1))
            for start, h, first in letter_words(batch.column(0)):
                text = np.repeat(own[start : start + len(first) - 1], np.diff(first))
                inner = np.ones(len(h), bool)
                inner[first[:-1][first[:-1] < len(h)]] = False
                before, after = np.zeros_like(h), np.zeros_like(h)
                before[1:] = np.where(inner[1:], h[:-1], 0)
                after[:-1] = np.where(inner[1:], h[1:], 0)
                both = arrays.mix(arrays.mix(before) + after)
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in (h, both, text)], ["word", "context", "own"])

    seen = rows.where("y > 0").select("text", F.xxhash64("text").alias("own")).mapInArrow(contexts, "word long, context long, own long")
    often = seen.groupBy("word").agg(F.least(F.count_distinct("context"), F.count_distinct("own")).alias("n")).where(F.col("n") > z * z)
    found = often.toArrow()
    word = np.asarray(found.column("word")).view(np.uint64)
    order = np.argsort(word)
    word, a = word[order], np.asarray(found.column("n"), float)[order]
    if not len(word):
        return None
    shared = sharing.share(spark, word)

    def count(batches):
        word = sharing.use(shared)
        rows, hits, size = np.zeros((2, len(word)), np.int64), np.zeros((2, len(word)), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column(0)).astype(np.int64)
            for start, h, first in letter_words(batch.column(1)):
                owner = np.repeat(toxic[start : start + len(first) - 1], np.diff(first))
                size += np.bincount(owner, minlength=2)
                row, place = held(word, h, first)
                kind = toxic[start + row]
                hits += np.bincount(kind * len(word) + place, minlength=2 * len(word)).reshape(2, -1)
                one = np.unique(row * len(word) + place)
                rows += np.bincount(toxic[start + one // len(word)] * len(word) + one % len(word), minlength=2 * len(word)).reshape(2, -1)
        for t in range(2):
            (some,) = np.nonzero(hits[t])
            out = np.append(some, -1), np.full(len(some) + 1, t), np.append(rows[t][some], 0), np.append(hits[t][some], size[t])
            yield pa.record_batch([pa.array(x) for x in out], ["place", "toxic", "rows", "hits"])

    flagged = rows.select((F.col("y") > 0).cast("int").alias("toxic"), "text")
    sums = flagged.mapInArrow(count, "place long, toxic long, rows long, hits long").groupBy("place", "toxic").agg(
        F.sum("rows").alias("rows"), F.sum("hits").alias("hits")).toArrow()
    place, toxic, n, hit = (np.asarray(sums.column(c)) for c in ("place", "toxic", "rows", "hits"))
    seen_in, rate, total = np.zeros((2, len(word))), np.zeros((2, len(word))), np.ones(2)
    total[toxic[place < 0]] += hit[place < 0]
    own = place >= 0
    seen_in[toxic[own], place[own]], rate[toxic[own], place[own]] = n[own], hit[own]
    mark = lower_bound(a, a + seen_in[0], z) > 0.5
    if not mark.any():
        return None
    rate = (rate[:, mark] + 0.5) / total[:, None]
    return word[mark], np.log(rate[1] / rate[0]), float((rate[1] - rate[0]).sum()), float(np.log(size[True] / size[False]))


def held(word: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in the sorted ``word`` of each of the rows' words ``h`` that is in it."""
    at = np.minimum(np.searchsorted(word, h), len(word) - 1)
    hit = word[at] == h
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[hit], at[hit]


def toxicity(column, found) -> np.ndarray:
    """Chance of every row to be toxic, from how often it holds marks for its length (Poisson rates); 0 without any."""
    out = np.zeros(len(column))
    if found is None:
        return out
    word, ratio, excess, prior = found
    for start, h, first in letter_words(column):
        row, place = held(word, h, first)
        odds = prior + np.bincount(row, ratio[place], len(first) - 1) - excess * np.diff(first)
        some = np.unique(row)
        out[start + some] = 1 / (1 + np.exp(-np.clip(odds[some], -30, 30)))
    return out


def evidence(docs: DataFrame, model, text_col: str, name: str, found=None) -> DataFrame:
    """Adds the log-likelihood ratio as column ``name`` and the chance to be toxic as ``quality_toxicity``; all other columns
    pass unchanged."""
    shared = sharing.share(docs.sparkSession, (model, found))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), T.StructField("quality_toxicity", T.DoubleType())])

    def run(batches):
        model, found = sharing.use(shared)
        w, mean, scale = model or (np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES))
        for batch in batches:
            z = (features(batch.column(text_col)) - mean) / scale
            score = np.clip(z @ w[:-1] + w[-1], -12, 12)
            more = [pa.array(score, pa.float64()), pa.array(toxicity(batch.column(text_col), found), pa.float64())]
            yield pa.record_batch([*batch.columns, *more], names=schema.names)
            arrays.give_back()

    return docs.mapInArrow(run, schema)


def _strength(groups: DataFrame, mean: str, n: str, prior: float) -> float:
    """Rows that the prior counts for: from the variance of group means beyond sampling noise."""
    noise = F.col(mean) * (1 - F.col(mean)) / F.col(n)
    row = groups.where(F.col(n) >= 2).agg(F.avg((F.col(mean) - prior) ** 2).alias("v"), F.avg(noise).alias("e")).first()
    between = max((row.v or 0.0) - (row.e or 0.0), 1e-4)
    return float(min(max(prior * (1 - prior) / between - 1, 1.0), 1e4))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """From rows (host, path, llr): sums per path (s, n) with its host's shrunken mean, the global mean, the path strength."""
    soft = F.expr("1 / (1 + exp(-llr))")
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.sum(soft).alias("s"), F.count("*").alias("n")))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = (total.s + 1) / (total.n + 2) if total.n else 0.5
    hosts = paths.where("host is not null").groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    hosts = hosts.withColumn("hm", F.col("hs") / F.col("hn"))
    strength = _strength(hosts, "hm", "hn", prior)
    hosts = hosts.select("host", ((F.col("hs") + strength * prior) / (F.col("hn") + strength)).alias("host_mean"))
    sites = paths.where("host is not null").join(hosts, "host")
    own = _strength(sites.withColumn("m", F.col("s") / F.col("n")), "m", "n", prior)
    return sites, prior, own


def score(seen: DataFrame, rows: DataFrame, cut: float, fitted: bool) -> DataFrame:
    """Adds ``quality_posterior`` (chance to be good) and ``quality_kept`` to ``rows``; ``seen`` has the evidence of all of them."""
    llr, host, path = "quality_llr", "quality_own_host", "quality_own_path"
    sites, prior, own = posteriors(seen.select(F.col(llr).alias("llr"), F.col(host).alias("host"), F.col(path).alias("path")))
    hosts = sites.groupBy("host").agg(F.first("host_mean").alias("quality_host_mean")).withColumnRenamed("host", "quality_host")
    sites = sites.where("path is not null").select(F.col("host").alias("quality_site_host"), F.col("path").alias("quality_site_path"),
                                                   F.col("s").alias("quality_s"), F.col("n").alias("quality_n"))
    soft = 1 / (1 + F.exp(-F.col(llr)))
    out = rows.join(hosts, F.col(host) == F.col("quality_host"), "left").join(
        sites, (F.col(host) == F.col("quality_site_host")) & (F.col(path) == F.col("quality_site_path")), "left")
    above = F.coalesce("quality_host_mean", F.lit(prior))
    mean = F.when(F.col("quality_n").isNull(), above).otherwise(
        (F.greatest(F.col("quality_s") - soft, F.lit(0.0)) + own * above) / (F.col("quality_n") - 1 + own))
    mean = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    quality = 1 / (1 + F.exp(-(F.col(llr) + F.log(mean / (1 - mean)))))
    out = out.select(*(F.col(f"`{c}`") for c in rows.columns), (quality if fitted else F.lit(0.5)).alias("quality_posterior"))
    good = F.col("quality_posterior") >= cut if fitted else F.lit(True)
    return out.withColumn("quality_kept", good & (F.col("quality_toxicity") < cut))


def _marks(docs, labels, id_col, text_col, toxic_col, fit_rows):
    return marks(docs, labels, id_col, text_col, toxic_col, fit_rows) if toxic_col in labels.columns else None


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", fit_rows: int = 20_000, cut: float = 0.5, toxic_col: str = "toxic") -> DataFrame:
    """Per row: ``id_col``, ``llr`` (document evidence), ``quality`` (posterior), ``toxicity`` (chance) and ``kept``."""
    model = train(docs, labels, id_col, text_col, label_col, fit_rows)
    found = _marks(docs, labels, id_col, text_col, toxic_col, fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("quality_own_host"), path.cast("string").alias("quality_own_path"),
                       F.col(text_col).cast("string").alias("text"))
    seen = cut_lineage(evidence(rows, model, "text", "quality_llr", found).drop("text"))
    return score(seen, seen, cut, model is not None).select(F.col("id").alias(id_col), F.col("quality_llr").alias("llr"), F.col("quality_posterior").alias("quality"),
                                                            F.col("quality_toxicity").alias("toxicity"), F.col("quality_kept").alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
         label_col: str = "quality", fit_rows: int = 20_000, cut: float = 0.5, toxic_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were; texts are read once more instead of shuffled."""
    model = train(docs, labels, id_col, text_col, label_col, fit_rows)
    found = _marks(docs, labels, id_col, text_col, toxic_col, fit_rows)
    named = docs.select("*", host.cast("string").alias("quality_own_host"), path.cast("string").alias("quality_own_path"))
    small = cut_lineage(evidence(named.select("quality_own_host", "quality_own_path", F.col(text_col).cast("string").alias("quality_text")),
                                 model, "quality_text", "quality_llr").drop("quality_text", "quality_toxicity"))
    whole = evidence(named, model, text_col, "quality_llr", found)
    return score(small, whole, cut, model is not None).where("quality_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
