"""PII: fixed patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

The patterns give the base spans of whole texts: kind, start, end (code points, end exclusive), leftmost and not
overlapping within a kind. The tagger learns from such spans of a bounded, documented sample of texts, with their digits
and separators varied so that it also knows what the patterns miss, and adds spans that overlap no base span and keep the
rules of their kind (parts of an address at most 255, check sum of a card, number of digits).

Tagging covers whole texts: every kind holds a digit or an at sign, so every stretch of text within ``MARGIN`` of such
a cue is cut into windows of ``WIDTH`` characters that overlap by half; a window without a cue has no span by
definition. Windows are decoded by Viterbi. Around candidate spans that touch a cut edge a window of twice the length is
decoded, and again, until they end inside it. The spans of all windows of a document are reconciled globally: the
disjoint set of largest total score is taken (weighted interval scheduling).

Null and empty texts have no spans. Repeated rows and ids are handled row by row. Ties go to the earlier span.
Memory holds one batch and one block of windows, or the longest span with its surroundings.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cindergrid.llm import arrays, sharing

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
WIDTH, MARGIN, BLOCK = 64, 24, 512
#: Size of the hidden state and of a character's vector.
HIDDEN, VECTOR = 12, 10
TAGS = 1 + 2 * len(KINDS)

_RUN = r"A-Za-z0-9._%+-"
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(rf"[{_RUN}]+$")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]+")
_HEAD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        # The longest run before the sign is where a leftmost match must begin.
        start = at
        while start > last and text[start - 1] in _HEAD_CHARS:
            start -= 1
        tail = _EMAIL_TAIL.match(text, at) if start < at else None
        last = tail.end() if tail else at + 1
        if tail:
            out.append(("email", start, last))
        at = text.find("@", last)
    if _CUE.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 20 and int(p) <= 255 or not p.strip("0") for p in m.groups()):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def codes(text: str) -> np.ndarray:
    """Characters as 0..99: ASCII signs as they are, all letters and digits too, the rest as one class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 32, 1, np.where(points < 127, points - 30, 0)).astype(np.int64)


class Tagger:
    """Bidirectional LSTM emissions with linear-chain CRF; tag 0 is outside, 1 + 2k begins kind k, 2 + 2k continues it."""

    def __init__(self, seed: int = 5):
        random = np.random.Generator(np.random.PCG64(seed))
        self.p = {"vec": random.normal(0, 0.3, (100, VECTOR)), "out": random.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS),
                  "move": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p["w" + d] = random.normal(0, 0.25, (VECTOR + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p["bias"][0] = 1.0
        legal = np.full((TAGS, TAGS), -1e4)
        legal[:, 0] = legal[:, 1::2] = 0
        for k in range(len(KINDS)):
            legal[1 + 2 * k, 2 + 2 * k] = legal[2 + 2 * k, 2 + 2 * k] = 0
        self.legal = legal

    def _lstm(self, x, d, keep=None):
        """Hidden states (time, batch, HIDDEN) of inputs in reading order of direction d."""
        w, c = self.p["w" + d], self.p["c" + d]
        steps, n = x.shape[:2]
        first = x @ w[:VECTOR] + c
        h, s = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        out = np.empty((steps, n, HIDDEN), x.dtype)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            z = first[t] + h @ w[VECTOR:]
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            new = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            before, was = h, s
            s = f * s + i * new
            th = np.tanh(s)
            h = o * th
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, new, th, before, was))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (time, batch, TAGS) of code windows (batch, time)."""
        x = self.p["vec"][ids.T]
        return np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], 2) @ self.p["out"] + self.p["bias"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, time) and the emission of each over that of outside."""
        e = self.emissions(ids)
        steps, n = e.shape[:2]
        move = self.p["move"] + self.legal
        score = e[0].copy()
        score[:, 2::2] = -1e4
        back = np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + move
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        gain = np.take_along_axis(e, tags.T[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags, gain.T

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag sequences and its gradient."""
        p, (n, steps) = self.p, ids.shape
        x = p["vec"][ids.T]
        kept = {"f": [], "b": []}
        hidden = np.concatenate([self._lstm(x, d, kept[d]) for d in "fb"], 2)
        e = hidden @ p["out"] + p["bias"]
        move = p["move"] + self.legal

        def fold(a):
            top = a.max(1, keepdims=True)
            return np.log(np.exp(a - top).sum(1)) + top[:, 0]

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = fold(alpha[t - 1][:, :, None] + move) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = fold((beta[t + 1] + e[t + 1])[:, :, None] + move.T)
        whole = fold(alpha[-1][:, :, None])[:, 0]
        share = np.exp(alpha + beta - whole[None, :, None])
        gold = np.zeros_like(e)
        rows = np.arange(n)
        for t in range(steps):
            gold[t, rows, tags[:, t]] = 1
        g_move = np.zeros_like(move)
        path = e[np.arange(steps)[:, None], rows, tags.T].sum(0)
        for t in range(1, steps):
            both = alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - whole[:, None, None]
            g_move += np.exp(both).sum(0)
            np.add.at(g_move, (tags[:, t - 1], tags[:, t]), -1)
            path += move[tags[:, t - 1], tags[:, t]]
        g_e = (share - gold) / n
        g = {"move": g_move / n, "bias": g_e.sum((0, 1)), "out": np.tensordot(hidden, g_e, ((0, 1), (0, 1)))}
        g_h = g_e @ p["out"].T
        g_x = np.zeros_like(x)
        for d, part in (("f", g_h[:, :, :HIDDEN]), ("b", g_h[:, :, HIDDEN:])):
            w = p["w" + d]
            g_w, g_c = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, ds = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, i, f, o, new, th, before, was in reversed(kept[d]):
                dh = dh + part[t]
                ds = ds + dh * o * (1 - th * th)
                z = np.concatenate([ds * new * i * (1 - i), ds * was * f * (1 - f), dh * th * o * (1 - o), ds * i * (1 - new * new)], 1)
                g_w += np.concatenate([x[t], before], 1).T @ z
                g_c += z.sum(0)
                back = z @ w.T
                g_x[t] += back[:, :VECTOR]
                dh, ds = back[:, VECTOR:], ds * f
            g["w" + d], g["c" + d] = g_w, g_c
        g["vec"] = np.zeros_like(p["vec"])
        np.add.at(g["vec"], ids.T, g_x)
        return float((whole - path).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 500, batch: int = 48, rate: float = 0.02) -> Tagger:
        """Adam on seeded batches; then single precision."""
        random = np.random.Generator(np.random.PCG64(9))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in "mv")
        for step in range(1, steps + 1):
            pick = random.integers(0, len(ids), batch)
            _, g = self.gradient(ids[pick], tags[pick])
            norm = np.sqrt(sum((x**2).sum() for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.legal = self.legal.astype(np.float32)
        return self


def plausible(kind: str, text: str) -> bool:
    """Whether a candidate span could be personal data of its kind, whatever its separators: the rules that the patterns
    check after matching hold for the tagger's spans too."""
    numbers = re.findall("[0-9]+", text)
    size = sum(map(len, numbers))
    if kind == "email":
        return "@" in text.strip("@") and "." in text
    if kind == "ip":
        return len(numbers) == 4 and all(int(n[:20]) <= 255 for n in numbers)
    if kind == "card":
        return 16 <= size <= 19 and luhn("".join(numbers))
    return 8 <= size <= 15


def with_check(text: str) -> str:
    """The text with its last digit set so that its digits pass Luhn."""
    at = max(i for i, c in enumerate(text) if c in "0123456789")
    others = "".join(c for c in text if c in "0123456789")[:-1]
    (last,) = (d for d in "0123456789" if luhn(others + d))
    return text[:at] + last + text[at + 1 :]


def varied(text: str, spans, random) -> tuple[str, list]:
    """A copy of a text whose spans have other digits (cards such that pass Luhn) and addresses other letters; more than half
    get separators that the patterns don't know, and some addresses a shorter name or domain, or a digit in it."""
    def drawn(c):
        if c in "0123456789":
            return str(random.integers(0, 10))
        return chr(97 + random.integers(0, 26)) if "a" <= c <= "z" else c

    out, moved, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        new = "".join(c if kind != "email" and not c.isdigit() else drawn(c) for c in text[a:b])
        odd = random.random() < 0.6
        if kind == "card":
            new = with_check(new)
            if odd:
                digits = re.sub("[^0-9]", "", new)
                new = str(random.choice([".", "/", " ", "-"])).join(digits[i : i + 4] for i in range(0, len(digits), 4))
        elif kind == "phone" and odd:
            new = re.sub("[() -]+", str(random.choice([".", "/", " "])), new)
        elif kind == "email":
            name, _, host = new.partition("@")
            if host.count(".") > 1 and random.random() < 0.5:
                host = host.partition(".")[2]
            if random.random() < 0.3:
                name = name.replace(".", "")
            if random.random() < 0.3:
                host = host[: host.rfind(".")] + str(random.integers(0, 10)) + host[host.rfind(".") :]
            new = name + (str(random.choice([" @ ", "@ ", " at@ "])) if odd else "@") + host
        out += [text[at:a], new]
        size += a - at
        moved.append((kind, size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), moved


def training_windows(texts: list[str], most: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Code windows with tags around the spans and other cues of the texts; of more than ``most`` a seeded draw over all."""
    random = np.random.Generator(np.random.PCG64(3))
    ids, tags = [], []
    for text in texts:
        spans = base_spans(text)
        for turn in range(1 + 4 * bool(spans)):
            own, marks = (text, spans) if not turn else varied(text, spans, random)
            code, tag = codes(own), np.zeros(len(own), np.int64)
            for kind, a, b in sorted(marks, key=lambda s: -KINDS.index(s[0])):
                k = KINDS.index(kind)
                tag[a:b] = 2 + 2 * k
                tag[a] = 1 + 2 * k
                if b < len(tag) and tag[b] and tag[b] % 2 == 0:
                    tag[b] -= 1
            places = [a for _, a, _ in marks] + [m.start() for m in _CUE.finditer(own)][:: max(1, len(own) // 400)][:4]
            for a in places[:12]:
                at = max(0, min(a - int(random.integers(4, WIDTH - 20)), len(own) - WIDTH))
                window, mark = code[at : at + WIDTH], tag[at : at + WIDTH].copy()
                while len(mark) and mark[0] and mark[0] % 2 == 0 and (run := int(np.argmax(np.append(mark[1:] != mark[0], True))) + 1):
                    mark[:run] = 0
                ids.append(np.pad(window, (0, WIDTH - len(window))))
                tags.append(np.pad(mark, (0, WIDTH - len(mark))))
    drawn = np.sort(random.permutation(len(ids))[:most])
    return np.array(ids).reshape(-1, WIDTH)[drawn], np.array(tags).reshape(-1, WIDTH)[drawn]


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 1500, most_windows: int = 3000) -> Tagger:
    """Fit on about ``sample_rows`` texts of at most 4,000 characters that hold a cue, drawn by a hash of the text; of
    their windows ``most_windows`` are drawn, whatever text they are from."""
    text = F.col(text_col).cast("string")
    some = docs.select(text.alias("text")).where(F.length("text") <= 4000).where(F.col("text").rlike("[0-9@]"))
    total = some.count()
    rows = some.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))).distinct().collect()
    ids, tags = training_windows(sorted(r.text for r in rows), most_windows)
    return Tagger().fit(ids, tags) if len(ids) else Tagger()


def stretches(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the windows that cover all cues with their margins."""
    out, to = [], -1
    for m in _CUE.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a > to and out and out[-1][1] > a:
            a = out[-1][1]
        if out and a <= to:
            out[-1][1] = b
        else:
            out.append([a, b])
        to = b
    windows = []
    for a, b in out:
        while True:
            windows.append((a, min(a + WIDTH, b)))
            if a + WIDTH >= b:
                break
            a += WIDTH // 2
    return windows


def reconcile(found: list[tuple[int, int, int, float]], base) -> list[tuple[str, int, int]]:
    """Of candidates (start, end, kind, score), the disjoint set of largest score that overlaps no base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    free = {}
    for a, b, kind, score in found:
        i = bisect.bisect_left(starts, b)
        if i and reach[i - 1] > a:
            continue
        free[a, b, kind] = max(score, free.get((a, b, kind), 0.0))
    items = sorted(free, key=lambda s: (s[1], s[0], s[2]))
    ends, best, choice = [s[1] for s in items], [0.0], []
    for i, (a, b, kind) in enumerate(items):
        before = bisect.bisect_right(ends, a, 0, i)
        with_it = best[before] + free[a, b, kind]
        choice.append(before if with_it > best[i] else None)
        best.append(max(with_it, best[i]))
    out, i = [], len(items)
    while i:
        if choice[i - 1] is None:
            i -= 1
        else:
            a, b, kind = items[i - 1]
            out.append((KINDS[kind], a, b))
            i = choice[i - 1]
    return out[::-1]


def decoded(tagger: Tagger, windows: list[bytes]) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind, score) of the candidates of each window of codes; windows of like length are decoded together."""
    spans = [[] for _ in windows]
    order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
    at = 0
    while at < len(order):
        to, width = at, WIDTH
        while to < len(order) and (to == at or (to - at + 1) * max(WIDTH, len(windows[order[to]])) <= BLOCK * WIDTH):
            width = max(width, len(windows[order[to]]))
            to += 1
        ids = np.zeros((to - at, width), np.int64)
        for i, w in enumerate(order[at:to]):
            ids[i, : len(windows[w])] = np.frombuffer(windows[w], np.uint8)
        tags, gain = tagger.decode(ids)
        for i, w in enumerate(order[at:to]):
            own = tags[i, : len(windows[w])]
            for b in np.flatnonzero(own % 2).tolist():
                other = own[b + 1 :] != own[b] + 1
                e = b + 1 + (int(other.argmax()) if other.any() else len(other))
                spans[w].append((b, e, int(own[b] - 1) // 2, float(gain[i, b:e].mean()) * (e - b)))
        at = to
    return spans


def wider(cut: list, closed: list, size: int) -> list[tuple[int, int]]:
    """Windows, apart from each other, for candidates (start, end, kind, window) that a window's edge cuts: each window as
    long again on the cut side. Candidates within a closed one of their kind need none."""
    reach = {}
    for kind in {c[2] for c in closed}:
        own = sorted(c[:2] for c in closed if c[2] == kind)
        reach[kind] = [a for a, _ in own], np.maximum.accumulate([b for _, b in own]).tolist()
    regions = set()
    for s, e, kind, (a, b) in cut:
        starts, ends = reach.get(kind, ([], []))
        i = bisect.bisect_right(starts, s)
        if not i or ends[i - 1] < e:
            regions.add((max(0, a - (b - a)) if s == a else a, min(size, b + (b - a)) if e == b else b))
    out = []
    for a, b in sorted(regions):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def added_spans(tagger: Tagger, texts: list[str], bases: list, least: float, valid=None) -> list[list[tuple[str, int, int]]]:
    """Reconciled spans of the tagger for each text; equal windows are decoded once per round. Windows around candidates
    that touch a cut edge are decoded again, wider each round, until the candidates end inside. Candidates for which
    ``valid(kind, text)`` does not hold are left out."""
    found, closed, code = [[] for _ in texts], [[] for _ in texts], {}
    todo = [(row, a, b) for row, text in enumerate(texts) for a, b in stretches(text)]
    while todo:
        place, windows, owners, cut = {}, [], [], {}
        for row, a, b in todo:
            if row not in code:
                code[row] = codes(texts[row]).astype(np.uint8)
            key = code[row][a:b].tobytes()
            owners.append((row, a, b, place.setdefault(key, len(windows))))
            if len(windows) < len(place):
                windows.append(key)
        spans = decoded(tagger, windows)
        for row, a, b, w in owners:
            size = len(texts[row])
            for s, e, kind, score in spans[w]:
                if (s == 0 and a > 0) or (e == b - a and b < size):
                    cut.setdefault(row, []).append((a + s, a + e, kind, (a, b)))
                    continue
                closed[row].append((a + s, a + e, kind))
                if e - s >= 6 and score >= least * (e - s) and (valid is None or valid(KINDS[kind], texts[row][a + s : a + e])):
                    found[row].append((a + s, a + e, kind, score))
        todo = [(row, a, b) for row, some in cut.items() for a, b in wider(some, closed[row], len(texts[row]))]
    return [reconcile(f, base) if f else [] for f, base in zip(found, bases)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _rows(column):
    """Texts of a column in groups of about a megabyte."""
    texts, size = [], 0
    for x in column:
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size > 1 << 20:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per row: ``id_col``, ``base`` and ``added`` spans, each an array of (kind, start, end); ``least`` is the mean
    emission over outside that an added span needs."""
    shared = sharing.share(docs.sparkSession, tagger)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[id_col], T.StructField("base", span), T.StructField("added", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            base, added = [], []
            for texts in _rows(batch.column(1)):
                own = [base_spans(t) for t in texts]
                base += own
                added += added_spans(sharing.use(shared), texts, own, least, plausible)

            def pack(rows):
                return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], arrow)

            yield pa.record_batch([batch.column(0), pack(base), pack(added)], [id_col, "base", "added"])
            arrays.give_back()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def mask(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with personal data of ``text_col`` replaced by its kind; other columns and null texts as they were."""
    shared = sharing.share(docs.sparkSession, tagger)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for texts in _rows(batch.column(at)):
                own = [base_spans(t) for t in texts]
                more = added_spans(sharing.use(shared), texts, own, least, plausible)
                out += [mask(t, [*a, *b]) for t, a, b in zip(texts, own, more)]
            empty = batch.column(at).is_null().to_pylist()
            text = pa.array([None if e else t for t, e in zip(out, empty)], pa.string())
            yield pa.record_batch([*batch.columns[:at], text, *batch.columns[at + 1 :]], names=names)
            arrays.give_back()

    return docs.mapInArrow(run, docs.schema)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
