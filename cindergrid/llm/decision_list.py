"""Quality rules: ordered lists of threshold conjunctions, learned by sequential covering, applied as Spark conditionals.

``statistics`` derives whole-text statistics with built-in functions only. ``learn`` grows rules on labelled rows: a
rule starts empty and takes, one at a time, the threshold condition of best gain (first-order inductive learner); it is
pruned while dropping its last condition doesn't hurt its precision; rows that it covers leave, and the next rule is
grown. Every step is one grouped count of the labelled statistics by bin; thresholds are percentiles.
All labelled rows are used. A row takes the verdict of the first rule that holds, else the default (keep).

Null texts have no words and all statistics 0. Repeated labels of an id count once, as their smallest; null labels and
ids don't count. Without bad labelled rows the list is empty. Repeated rows are judged row by row; ties between
conditions go to the earlier statistic, then the smaller threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.session import cut_lineage

#: Fixed values of the base statistics: separators of words, symbols.
SEPARATORS = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"

#: Statistics that conditions are made of.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "bar_share",
            "line_words")
#: Repeated windows of a text up to which each window is looked up among them.
FEW = 16


def _count(text: Column, signs: str) -> Column:
    """How many characters of ``text`` are among the ASCII ``signs``; one plain search a sign is faster than one for all."""
    out = F.lit(0)
    for c in signs:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base statistics, and the shares that conditions use."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = F.col("text")
    for c in SEPARATORS[:-1]:
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    step = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    step = step.withColumn("words", F.array_remove(F.split(blank, " "), "")).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SEPARATORS)) != ""))
    size = F.size("words")
    # One hash for each three-word window, in order.
    step = step.withColumn("windows", F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(
        F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    step = step.select("id", size.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                       _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.size("lines").alias("n_lines"), "windows", F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
                       _count(F.col("text"), "!").alias("n_mark"), _count(F.col("text"), "|").alias("n_bar"), F.length("text").alias("n_chars"))
    # Only texts that repeat a window need to know where. Sorting brings equal hashes together; few repeated ones are
    # looked up as they are, many through a sort of all windows with their places.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    step = step.withColumn("sorted", F.when(some, F.sort_array("windows")))
    step = step.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, k: (k > 0) & (F.get("sorted", k - 1) == x))))
    few = F.array_compact(F.transform("windows", lambda h, i: F.when(F.array_contains(F.col("twice"), h), i)))
    step = step.withColumn("pairs", F.when(F.size("twice") > FEW, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = F.filter("pairs", lambda x, k: ((k > 0) & (F.get("pairs", k - 1)["h"] == x["h"])) | (
        (k < F.size("pairs") - 1) & (F.get("pairs", k + 1)["h"] == x["h"])))
    step = step.withColumn("places", F.when(some & (F.size("twice") <= FEW), few).when(some, F.sort_array(F.transform(equal, lambda x: x["i"]))))
    covered = F.aggregate(F.transform("places", lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("places", k - 1)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("n_chars"), F.lit(1))
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbol_share"), (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"), (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_mark") / n).alias("mark_share"), (F.col("n_bar") / n).alias("bar_share"), (n / F.greatest(F.col("n_lines"), F.lit(1))).alias("line_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '>' or '<=', threshold) and the bad and good labelled rows that it covered."""

    conditions: tuple
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, way, value in self.conditions:
            out = out & (F.col(name) > value if way == ">" else F.col(name) <= value)
        return out

    def __str__(self):
        return " and ".join(f"{n} {w} {v:g}" for n, w, v in self.conditions) + f" -> reject ({self.bad} bad, {self.good} good)"


def _counts(free: DataFrame, conditions: tuple, cut: dict) -> dict:
    """Bad and good rows under ``conditions`` and each further condition: rows are counted by statistic and bin, in one
    grouped aggregate, and the few counts are summed along the bins. Key () has the rows under ``conditions`` alone."""
    rows = free.where(Rule(conditions, 0, 0).column()).select("bad", F.posexplode("bins").alias("feature", "bin"))
    at: dict[int, dict[int, list[int]]] = {}
    for r in rows.groupBy("feature", "bin", "bad").count().collect():  # at most statistics x thresholds x 2 rows
        at.setdefault(r.feature, {}).setdefault(r.bin, [0, 0])[0 if r.bad else 1] += r["count"]
    out = {(): tuple(map(sum, zip(*at.get(0, {0: [0, 0]}).values())))}
    for f, name in enumerate(FEATURES):
        low = [0, 0]
        for k, value in enumerate(cut[name]):
            low = [x + y for x, y in zip(low, at.get(f, {}).get(k, (0, 0)))]
            out[name, ">", value] = tuple(x - y for x, y in zip(out[()], low))
            out[name, "<=", value] = tuple(low)
    return out


def learn(labelled: DataFrame, most_rules: int | None = None, most_conditions: int | None = None, precision: float = 0.9, cuts: int = 20,
          least_share: float = 0.001) -> list[Rule]:
    """Ordered rules from rows of FEATURES and ``bad`` (0 or 1).

    A rule grows while a condition gains and good rows remain. Covering ends when no bad rows remain, or the next rule is not
    ``precision`` or covers fewer than two or ``least_share`` of all bad rows. Numbers of rules and conditions are limited on request."""
    from math import inf, log2

    most_rules, most_conditions = (inf if x is None else x for x in (most_rules, most_conditions))

    shares = [(k + 0.5) / cuts for k in range(cuts)]
    picked = labelled.agg(*(F.percentile_approx(c, shares, 10_000).alias(c) for c in FEATURES),
                          *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(c)), shares, 10_000).alias(f"bad_{c}") for c in FEATURES)).first()
    cut = {c: sorted({float(v) for v in [*(picked[c] or []), *(picked[f"bad_{c}"] or [])]}) for c in FEATURES}
    if not any(cut.values()):
        return []

    def passed(name):
        return F.size(F.filter(F.array(*map(F.lit, cut[name])), lambda v: F.col(name) > v))

    binned = cut_lineage(labelled.withColumn("bins", F.array(*map(passed, FEATURES))))
    rules: list[Rule] = []
    least = 2
    while len(rules) < most_rules:
        free = binned
        for r in rules:
            free = free.where(~r.column())
        counts = _counts(free, (), cut)
        bad, good = counts.pop(())
        if not bad:
            break
        if not rules:
            least = max(2, least_share * bad)
        steps = [((), bad, good)]
        while len(steps) <= most_conditions and steps[-1][2]:
            done, b0, g0 = steps[-1]
            if done:
                counts = _counts(free, done, cut)
                counts.pop(())
            base = log2(b0 / (b0 + g0))
            gain, at = max((b * (log2(b / (b + g)) - base) if b else float("-inf"), -i) for i, (b, g) in enumerate(counts.values()))
            if gain <= 1e-9:
                break
            option = list(counts)[-at]
            steps.append(((*done, option), *counts[option]))
        # Prune: fewer conditions where they are as precise, or where more leave too few rows.
        while len(steps) > 2 and (steps[-1][1] < least or _precise(steps[-2]) >= _precise(steps[-1]) - 0.002):
            steps.pop()
        rule = Rule(*steps[-1])
        if not rule.conditions or _precise(steps[-1]) < precision or rule.bad < least:
            break
        rules.append(rule)
    return rules


def _precise(step) -> float:
    return (step[1] + 0.5) / (step[1] + step[2] + 1)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Kept or not, and the number (from 1) of the deciding rule, 0 for the default."""
    number = F.lit(0)
    for i in range(len(rules), 0, -1):
        number = F.when(rules[i - 1].column(), F.lit(i)).otherwise(number)
    return number == 0, number


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          **options) -> tuple[DataFrame, list[Rule]]:
    """Statistics of every row with ``base_failed``, ``kept`` and ``rule``; and the list that was learned."""
    seen = cut_lineage(statistics(docs, id_col, text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (1 - F.min(label_col)).cast("int").alias("bad"))
    rules = learn(cut_lineage(seen.join(known, "id").select("bad", *FEATURES)), **options)
    kept, number = verdict(rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & kept).alias("kept"), number.cast("int").alias("rule")), rules
