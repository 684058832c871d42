"""Quality rules: a learned decision list over text statistics, DataFrame operations only.

Sequential covering on labelled statistics: a rule is grown literal by literal
(statistic <= or > threshold) by information gain over the rows that no rule covers
yet, pruned to the prefix that is best on separate rows, and kept if it is precise
there. The list becomes one ordered chain of conditional expressions.

Defined cases: a null, empty or blank text has no words, all counts zero, and fails
the base rule; a label other than 0 and 1 is left out; too few labels or one class
only give an empty list, which keeps every row that the base rule keeps; repeated
rows each get a row; rules of equal gain are taken in the order of the statistics; a
text of any length is counted whole, and its task holds its words; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize

#: Labelled rows that the list is learned from at most, drawn by hash.
SAMPLE_ROWS = 10_000
CUTS = [0.01, 0.03, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99]
MOST_RULES, MOST_LITERALS, LEAST_COVER, LEAST_PRECISION = 8, 3, 8, 0.9
BLANK = "[ \\t-\\r]"
# one by one: a class of single characters is a table in the JVM, one with ranges a chain of tests
SYMBOLS, MARKS, UPPER, DIGITS = "#*$%&|<>", "!?|", string.ascii_uppercase, string.digits
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate", "distinct_rate", "line_words"]


def statistics(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, the five counts of the base rule and what the features need, for every row.

    Words in repeated windows are found by 64-bit hashes of the windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # one pass over the text leaves the few characters that are counted by kind
    marks = F.regexp_replace(text, f"[^{SYMBOLS}{MARKS}{UPPER}{DIGITS}]+", "")
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marks.alias("k"), F.array_remove(F.split(text, BLANK + "+"), "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"))
    of = lambda kinds: F.length(F.regexp_replace(F.col("k"), f"[^{kinds}]+", "")).cast("long")
    counted = words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        of(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        of(UPPER).alias("n_upper"),
        of(MARKS).alias("n_marks"),
        of(DIGITS).alias("n_digits"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    names = [c for c in counted.columns if c != "h"]
    at = F.sequence(F.lit(0), F.col("n_words").cast("int") - window)
    grams = counted.select(*names, F.when(F.col("n_words") >= window, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(window)]))).alias("g"))
    again = (F.col("n_words") >= window) & (F.size("g") > F.size(F.array_distinct("g")))
    ranked = grams.select(*names, F.when(again, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    same = lambda i, j: F.get(F.col("s"), i)["x"] == F.get(F.col("s"), j)["x"]
    twice = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get(F.col("s"), i)["i"])), lambda p: p.isNotNull())
    placed = ranked.select(*names, F.when(F.col("s").isNotNull(), F.sort_array(twice)).alias("p"))
    steps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(window), b - a))
    return placed.select(*names, F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))), F.lit(0)).cast("long").alias("n_repeat_words"))


def features() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / chars,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / n,
        "upper_rate": F.col("n_upper") / chars,
        "mark_rate": F.col("n_marks") / chars,
        "digit_rate": F.col("n_digits") / chars,
        "distinct_rate": F.col("n_distinct") / n,
        "line_words": n / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def column(self, feature: Column) -> Column:
        return feature > self.cut if self.above else feature <= self.cut


Rule = tuple[Literal, ...]


def holds(rule: Rule, columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column(columns[x.feature])
    return out


def learn(stats: DataFrame, labels: DataFrame, target: str = "quality") -> list[Rule]:
    """Rules whose rows have label 0, in order."""
    known = labels.where(F.col(target).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max(target).alias("y"))
    table = stats.join(known, "doc_id").select("doc_id", "y", *[c.alias(f) for f, c in features().items()])
    order = F.xxhash64("doc_id")
    table = table.orderBy(order, "doc_id").limit(SAMPLE_ROWS).withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0)
    table = materialize(table.coalesce(1), "labelled")  # SAMPLE_ROWS narrow rows at most
    mine = {f: F.col(f) for f in FEATURES}
    quantiles = table.agg(*[F.percentile_approx(f, CUTS, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({*map(float, quantiles[f] or [])}) for f in FEATURES}
    rules: list[Rule] = []
    for _ in range(MOST_RULES):
        uncovered = ~F.lit(False)
        for r in rules:
            uncovered = uncovered & ~holds(r, mine)
        rule = grow(table.where("grow").where(uncovered), cuts, mine)
        if not rule:
            break
        # prune: the prefix that is best on the rows kept apart
        aside = table.where(~F.col("grow")).where(uncovered)
        sums = []
        for k in range(1, len(rule) + 1):
            hit = holds(rule[:k], mine).cast("int")
            sums += [F.sum(hit * (1 - F.col("y"))).alias(f"bad{k}"), F.sum(hit * F.col("y")).alias(f"good{k}")]
        seen = aside.agg(*sums).first()
        value = {k: (bad + 1) / (bad + good + 2) if bad + good >= LEAST_COVER / 2 else 0.0 for k in range(1, len(rule) + 1) for bad, good in [(seen[f"bad{k}"] or 0, seen[f"good{k}"] or 0)]}
        best = max(value, key=lambda k: (value[k], -k))
        bad, good = seen[f"bad{best}"] or 0, seen[f"good{best}"] or 0
        if bad + good == 0 or bad / (bad + good) < LEAST_PRECISION:
            break
        rules.append(rule[:best])
    return rules


def grow(rows: DataFrame, cuts: dict[str, list[float]], mine: dict[str, Column]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_LITERALS:
        bins = F.array(*[F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("b")) for f in FEATURES])
        # one row for each statistic and bin
        counts = rows.where(holds(rule, mine)).select("y", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(F.sum(1 - F.col("y")).alias("bad"), F.sum("y").alias("good")).collect()
        of: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            of.setdefault(r.f, {})[r.b] = (r.bad, r.good)
        if not of:
            break
        all_bad, all_good = (sum(v[i] for v in of[FEATURES[0]].values()) for i in (0, 1))
        if not all_bad or not all_good:
            break
        now = math.log2(all_bad / (all_bad + all_good))
        best: tuple[float, Literal] | None = None
        for f in FEATURES:
            for i, cut in enumerate(cuts[f]):
                for above in (False, True):
                    inside = [v for b, v in of[f].items() if (b > i) == above]
                    bad, good = sum(v[0] for v in inside), sum(v[1] for v in inside)
                    if bad + good >= LEAST_COVER and bad and bad + good < all_bad + all_good:
                        gain = bad * (math.log2(bad / (bad + good)) - now)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, Literal(f, above, cut))
        if best is None or best[0] <= 0:
            break
        rule = (*rule, best[1])
    return rule


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression over the statistics: False rejects."""
    mine = features()
    out: Column | None = None
    for r in rules:
        out = F.when(holds(r, mine), False) if out is None else out.when(holds(r, mine), False)
    return F.lit(True) if out is None else out.otherwise(True)


COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def counted(stats: DataFrame) -> DataFrame:
    """The counts of the base rule, and whether it fails."""
    return stats.select(*COUNTS, base_failed().alias("base_failed"))


def apply(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    stats = materialize(statistics(docs), "statistics")
    kept = ~base_failed() & verdict(learn(stats, labels, target))
    return stats.select(*COUNTS, base_failed().alias("base_failed"), kept.alias("kept"))
