"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

``statistics`` measures each text with built-in functions. ``learn`` takes a bounded
sample of labelled rows (``SAMPLE`` rows, those of least hash of their id), grows one
conjunction of thresholds after the other by FOIL gain on two thirds of them, prunes each
on the other third, and stops when the pruned rule isn't precise enough. ``verdict`` turns
the ordered rules into ``CASE WHEN`` branches. The main path holds no Python code.

Defined cases: null text has no words, so it fails the base rules; a null or repeated id
is a row of its own; labels that are null, or that repeat with other values, don't teach; of conditions of equal gain the first in the order of
FEATURES and cuts is taken; very long texts are taken whole;
without labels of both kinds the list is empty and the base rules decide alone; only the
id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

#: Labelled rows that teach, thresholds tried for each feature, conditions of a rule, rules of a list.
SAMPLE, CUTS, CONDITIONS, RULES = 6000, 24, 4, 12
#: A rule must be this precise, and cover so many junk rows, on either part of the sample.
PRECISION, COVER = 0.95, 5
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "n_words")


def repeated_words(words: Column, k: int = 3) -> Column:
    """How many words lie in a ``k``-word window found twice or more among ``words``.

    Windows are hashed and sorted with their position; equal neighbours repeat; the union of
    the repeated windows is measured over their sorted positions. O(n log n) a text.
    """
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(*(F.get(w, i + j) for j in range(k))).alias("h"), i.alias("p")))
    sorted_windows = let(words, lambda w: F.when(F.size(w) >= k, F.sort_array(hashed(w))))
    again = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
    positions = let(sorted_windows, lambda s: F.sort_array(F.transform(again(s), lambda x: x["p"])))
    steps = lambda p: F.zip_with(F.slice(p, 2, F.size(p)), p, lambda b, a: F.least(F.coalesce(b - a, F.lit(k)), F.lit(k)))
    return F.coalesce(let(positions, lambda p: F.aggregate(steps(p), F.lit(0), lambda t, x: t + x)), F.lit(0))


def measure(text: Column) -> Column:
    """One struct of the counts that the rules are about."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{common.SPACE}]"))
    of_class = lambda c: F.length(F.regexp_replace(text, f"[^{c}]+", ""))
    of_words = let(common.words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeats")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    parts = F.struct(of_words.alias("w"), of_lines.alias("l"), of_class("#*$%&|<>").alias("symbols"), of_class("A-Z").alias("upper"), of_class("!").alias("bang"))
    named = lambda x: {"n_words": x["w"]["n"], "word_chars": x["w"]["chars"], "n_symbols": x["symbols"], "n_dup_lines": x["l"]["dup"], "n_repeat_words": x["w"]["repeats"], "n_lines": x["l"]["n"], "n_upper": x["upper"], "n_bang": x["bang"]}
    return let(parts, lambda x: F.struct(*(v.cast("long").alias(k) for k, v in named(x).items())))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, the columns ``more``, and the counts of ``measure``."""
    return docs.select(F.col(id_col).alias("doc_id"), *more, measure(F.col(text_col)).alias("measured")).select("doc_id", *more, "measured.*")


def features(get=F.col) -> dict[str, Column]:
    """Scale-free features, rounded to three digits, of the counts that ``get`` finds by name."""
    share = lambda a, b: F.round(get(a) / F.greatest(get(b), F.lit(1)), 3)
    return {
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "bang_share": share("n_bang", "n_words"),
        "n_words": get("n_words").cast("double"),
    }


def base_failed(get=F.col) -> Column:
    return (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, row: tuple) -> bool:
        return (row[self.feature] > self.cut) is self.above

    def column(self, get=F.col) -> Column:
        x = features(get)[FEATURES[self.feature]]
        return x > self.cut if self.above else x <= self.cut


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: list[tuple[tuple, bool]], cuts: list[list[float]]) -> list[Condition]:
    """Conditions added one by one while FOIL's gain is positive."""
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        p0 = sum(junk for _, junk in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for f, marks in enumerate(cuts):
            ordered = sorted((row[f], junk) for row, junk in rows)
            p = n = at = 0
            for cut in marks:
                while at < len(ordered) and ordered[at][0] <= cut:
                    p, n, at = p + ordered[at][1], n + (not ordered[at][1]), at + 1
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if (g := _gain(a, b, p0, n0)) > best:
                        best, found = g, Condition(f, above, cut)
        if found is None:
            break
        rule.append(found)
        rows = [x for x in rows if found.holds(x[0])]
    return rule


def _worth(rule: list[Condition], rows: list[tuple[tuple, bool]]) -> tuple[float, int, int]:
    hit = [junk for row, junk in rows if all(c.holds(row) for c in rule)]
    p = sum(hit)
    return (2 * p - len(hit)) / len(hit) if hit else -1.0, p, len(hit)


def cover(rows: list[tuple[tuple, bool]]) -> list[list[Condition]]:
    """Ordered rules for junk from (features, is junk) rows; rows' order decides which prune."""
    cuts = []
    for f in range(len(FEATURES)):
        values = sorted({row[f] for row, _ in rows})
        # Half-way to the next value seen: a margin for texts between the clean and the bad.
        cuts.append(sorted({(values[k] + values[k + 1]) / 2 for i in range(CUTS) if (k := (len(values) - 1) * i // CUTS) + 1 < len(values)}))
    grow, prune = [x for i, x in enumerate(rows) if i % 3], rows[::3]
    rules: list[list[Condition]] = []
    while len(rules) < RULES:
        rule = _grow(grow, cuts)
        while len(rule) > 1 and _worth(rule[:-1], prune)[0] >= _worth(rule, prune)[0]:
            rule = rule[:-1]
        if not rule:
            break
        (_, p, n), (_, q, m) = _worth(rule, grow), _worth(rule, prune)
        if p < COVER or p < PRECISION * n or q < PRECISION * m:
            break
        rules.append(rule)
        grow, prune = ([x for x in part if not all(c.holds(x[0]) for c in rule)] for part in (grow, prune))
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    """The decision list for junk, from those of ``sample`` labelled rows that pass the base rules."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = most")
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("label_id"), (F.col("least") == 0).alias("is_junk"))
    # At most `sample` rows of 9 bytes: a proven bound.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = statistics(texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")), "doc_id", "text", "is_junk")
    taught = rows.select("doc_id", "is_junk", F.array(*features().values()).alias("x"), base_failed().alias("failed")).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()
    # What the base rules fail needs no learning. A filter in the plan would go below the join and measure every text.
    return cover([(tuple(r.x), r.is_junk) for r in taught if not r.failed])


def verdict(rules: list[list[Condition]], get=F.col) -> Column:
    """True where no rule of the list fires."""
    out = None
    for rule in rules:
        fires = rule[0].column(get)
        for c in rule[1:]:
            fires = fires & c.column(get)
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """``statistics`` with ``base_failed`` and ``kept``."""
    rules = learn(docs, labels)
    return statistics(docs, "doc_id", "text", *more).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, as they are; a text is measured once."""
    rules = learn(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(let(measure(F.col(text_col)), lambda m: ~base_failed(m.getField) & verdict(rules, m.getField)))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    judged = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
