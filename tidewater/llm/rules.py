"""Quality rules as learned decision lists [DataFrame functions only].

Statistics of every whole text are built-in expressions; sequential covering grows
threshold conjunctions for low quality on one part of a bounded labelled sample, prunes
them on another and emits the list as one ordered conditional expression.

Cases: a null text has no words and all counts zero; texts under the base limits are
never kept; without labels the list is empty and only the base limits decide; repeated
rows are returned each; an empty table gives an empty result; ids may be of any type
that has a text form; of the columns only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import clean_text, labelled_sample

#: Labelled rows from which rules are learned, at most.
SAMPLE_BOUND = 6000
_SPACE = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: rates, so that they hold for texts of any length.
FEATURES = ["symbol_rate", "mean_word", "dup_line_rate", "repeat_rate", "upper_rate", "bar_rate", "variety", "bang_rate"]


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _hold(d: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer cannot copy into later expressions or filters.

    A copy inside a lambda would be computed again for every word of a text; rows
    that come out of a generator are not substituted."""
    return d.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def with_statistics(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, base statistics, rates) of every whole text.

    Repeated three-word windows are found by sorting window hashes with their
    positions: linear memory and n log n time for a text of any length, no shuffle.
    """
    t, w, h = F.col("_t"), F.col("_w"), F.col("_h")
    trimmed = F.btrim(t, F.lit(_SPACE))
    d = docs.select("doc_id", *others, clean_text().alias("_t"))
    d = _hold(d, _w=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
              _lines=F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0))
    n = F.size(w).cast("long")
    d = _hold(d, _h=F.when(n > 2, F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))))
    d = _hold(d, _s=F.when(h.isNotNull() & (F.size(F.array_distinct(h)) < F.size(h)),
                           F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    hit = F.filter(s, lambda p, k: (p["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True) | (p["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True))
    covered = F.size(F.array_distinct(F.flatten(F.transform(hit, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))))
    lines = F.col("_lines")
    d = d.select(
        "doc_id", *others, n.alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(t, r"[#*$%&|<>]").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(s.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(lines).alias("_n_lines"), _count(t, r"\p{Lu}").alias("_upper"), _count(t, r"\|").alias("_bars"),
        _count(t, "!").alias("_bangs"), F.size(F.array_distinct(w)).alias("_distinct"))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    rates = {
        "symbol_rate": F.col("n_symbols") / words, "mean_word": F.col("word_chars") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)), "repeat_rate": F.col("n_repeat_words") / words,
        "upper_rate": F.col("_upper") / chars, "bar_rate": F.col("_bars") / words, "variety": F.when(F.col("n_words") > 1, F.log(F.col("_distinct").cast("double")) / F.log(F.col("n_words").cast("double"))).otherwise(1.0),
        "bang_rate": F.col("_bangs") / words}
    return d.select("doc_id", *others, *BASE, *(F.round(v, 6).alias(k) for k, v in rates.items()))


@dataclass(frozen=True)
class Test:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Test, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def _best_test(rows: list[dict], features: list[str]) -> tuple[float, Test] | None:
    """The test of most information gain for label 0 over ``rows``."""
    pos = sum(r["label"] == 0 for r in rows)
    neg, best = len(rows) - pos, None
    if not pos or not neg:
        return None
    before = math.log2(pos / (pos + neg))
    for f in features:
        ordered = sorted((r[f], r["label"] == 0) for r in rows)
        p = n = 0
        for k in range(len(ordered) - 1):
            p, n = p + ordered[k][1], n + (not ordered[k][1])
            if ordered[k][0] == ordered[k + 1][0]:
                continue
            cut = (ordered[k][0] + ordered[k + 1][0]) / 2
            for above, a, b in ((False, p, n), (True, pos - p, neg - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - before)) > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Test(f, above, cut))
    return best


def learn(rows: list[dict], features: list[str] = FEATURES, max_rules: int = 12, max_tests: int = 4, precision: float = 0.9, support: int = 5) -> list[Rule]:
    """Ordered rules for label 0 by sequential covering with reduced-error pruning.

    ``rows``: dicts of features, label and fold (0-9); folds under 7 grow rules, the
    others prune them.  A rule must reach ``precision`` and ``support``."""
    grow, prune, out = [r for r in rows if r["fold"] < 7], [r for r in rows if r["fold"] >= 7], []
    while len(out) < max_rules:
        rule, inside = (), grow
        while len(rule) < max_tests and (found := _best_test(inside, features)):
            rule += (found[1],)
            inside = [r for r in inside if found[1].holds(r)]
        if not rule:
            break

        def worth(r: Rule) -> float:
            got = [x for x in prune if _covers(r, x)]
            bad = sum(x["label"] == 0 for x in got)
            return (2 * bad - len(got)) / len(got) if got else -1.0

        while len(rule) > 1 and (shorter := max((rule[:k] for k in range(1, len(rule))), key=worth)) and worth(shorter) >= worth(rule):
            rule = shorter
        got = [r for r in grow + prune if _covers(rule, r)]
        if len(got) < support or sum(r["label"] == 0 for r in got) < precision * len(got):
            break
        out.append(rule)
        grow, prune = [r for r in grow if not _covers(rule, r)], [r for r in prune if not _covers(rule, r)]
    return out


def verdict(rules: list[Rule]) -> Column:
    """True where no rule fires: the list as one ordered conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_from(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_BOUND) -> list[Rule]:
    sample = labelled_sample(docs, labels, "quality", bound)
    # the list acts only on texts that meet the base limits, so it is learned from them
    stats = with_statistics(sample, "label", "fold").where(~_failed())
    return learn([r.asDict() for r in stats.orderBy("doc_id").collect()])


def quality_rules(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None, bound: int = SAMPLE_BOUND) -> DataFrame:
    """One row per document: doc_id, base statistics, base_failed, kept, and the rates."""
    rules = learn_from(docs, labels, bound) if rules is None else rules
    failed = _failed()
    return with_statistics(docs).select("doc_id", *BASE, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), *FEATURES)
