"""Quality rules: learned decision lists over text statistics.

Only DataFrame expressions compute and apply. Sequential covering grows one rule at a time: a
conjunction of thresholds on statistics, grown by information gain on one part of the labelled
rows and pruned on another, until no rule is worth adding. The list becomes one ordered Spark
conditional: the first rule that holds gives the verdict, otherwise the document is kept.
"""

from __future__ import annotations

import zlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import GAP

#: Statistics that rules may use, as ratios of the counted ones.
STATISTICS = (
    "n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio",
    "digit_ratio", "distinct_ratio", "end_mark_ratio", "bar_ratio", "mark_run_ratio", "words_per_line",
)


def counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, STATISTICS.

    n_repeat_words: words in 3-word windows found twice or more in the text, the first included.
    Windows are compared as 64-bit hashes: where all are distinct, which one pass over a hash set
    tells, no word repeats; else they are sorted with their places, and the places of equal
    neighbours, in order, cover three words each. n_dup_lines: lines with a word that equal an
    earlier line. Null and empty texts count 0 throughout and their ratios are 0. Whole texts are
    read and nothing is shuffled; repeated rows stay, and an empty table gives no rows.
    """
    carried = [c for c in (keep or []) if c not in ("doc_id", "text")]
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("txt"), *[F.col(c).alias(f"__k_{c}") for c in carried])
    d = d.withColumn("words", F.expr(f"filter(split(txt, '{GAP.replace(chr(92), chr(92) * 2)}', -1), w -> w <> '')"))
    d = d.withColumn("lines", F.expr("filter(split(txt, '\\n', -1), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"))
    d = d.withColumn("hashes", F.expr("CASE WHEN size(words) > 2 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE CAST(array() AS array<bigint>) END"))
    d = d.withColumn("n_repeat_words", F.expr("""
        CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE
          transform(array(array_sort(transform(hashes, (h, i) -> named_struct('h', h, 'i', i)))), s ->
            transform(array(sort_array(transform(filter(s, (x, k) ->
                (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))), p ->
              aggregate(sequence(0, size(p) - 1), 0L, (n, k) -> n + CASE WHEN k = size(p) - 1 THEN 3 ELSE least(3, p[least(k + 1, size(p) - 1)] - p[k]) END))[0])[0]
        END"""))  # fmt: skip
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.regexp_replace("txt", GAP, "")).cast("long"),
        "n_symbols": F.regexp_count("txt", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_upper": F.regexp_count("txt", F.lit(r"\p{Lu}")).cast("long"),
        "n_digits": F.regexp_count("txt", F.lit("[0-9]")).cast("long"),
        "n_distinct": F.size(F.array_distinct("words")).cast("long"),
        "n_ends": F.regexp_count("txt", F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long"),
        "n_bars": F.regexp_count("txt", F.lit(r"[|\t]")).cast("long"),
        "n_mark_runs": F.regexp_count("txt", F.lit(r"[!?#*$%&]{2,}")).cast("long"),
    })
    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))

    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"), per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("n_upper", "word_chars").alias("upper_ratio"), per("n_digits", "word_chars").alias("digit_ratio"),
        per("n_distinct", "n_words").alias("distinct_ratio"), per("n_ends", "n_words").alias("end_mark_ratio"),
        per("n_bars", "n_words").alias("bar_ratio"), per("n_mark_runs", "n_words").alias("mark_run_ratio"),
        per("n_words", "n_lines").alias("words_per_line"),
        *[F.col(f"__k_{c}").alias(c) for c in carried],
    )


@dataclass(frozen=True)
class Test:
    statistic: str
    at_least: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.statistic] >= self.value if self.at_least else row[self.statistic] < self.value

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c >= self.value if self.at_least else c < self.value


Rule = tuple[Test, ...]


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """Positives kept times the gain in information about being positive."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: list[dict], max_tests: int, cuts: int) -> Rule:
    rule: list[Test] = []
    while len(rule) < max_tests and any(r["bad"] for r in rows) and not all(r["bad"] for r in rows):
        p0 = sum(r["bad"] for r in rows)
        n0, best = len(rows) - p0, (1e-9, None)
        for s in STATISTICS:
            ordered = sorted((r[s], r["bad"]) for r in rows)
            p, places = 0, {x[0] for x in ordered[:: max(1, len(ordered) // cuts)]}
            for k, (v, bad) in enumerate(ordered):
                if k and v != ordered[k - 1][0] and v in places:
                    value = (v + ordered[k - 1][0]) / 2
                    below, above = (p, k - p), (p0 - p, n0 - (k - p))
                    best = max(best, (_gain(p0, n0, *above), Test(s, True, value)), (_gain(p0, n0, *below), Test(s, False, value)), key=lambda x: x[0])
                p += bad
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r)]
    return tuple(rule)


def _worth(rule: Rule, rows: list[dict]) -> float:
    """(bad - good) / covered on the pruning rows."""
    hit = [r["bad"] for r in rows if all(t.holds(r) for t in rule)]
    return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0


def learn_rules(rows: list[dict], max_rules: int = 12, max_tests: int = 4, cuts: int = 64, least_worth: float = 0.6, least_hits: int = 5) -> list[Rule]:
    """Sequential covering over rows of STATISTICS and bad (bool); every third row prunes.

    A rule that covers fewer than least_hits bad rows, or whose worth on the pruning rows or on
    all rows is under least_worth, ends the list.
    """
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < max_rules:
        grow, prune = [r for i, r in enumerate(left) if i % 3], [r for i, r in enumerate(left) if i % 3 == 0]
        rule = _grow(grow, max_tests, cuts)
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, prune), -len(r)))
        hit = [r for r in left if all(t.holds(r) for t in rule)]
        if sum(r["bad"] for r in hit) < least_hits or min(_worth(rule, left), _worth(rule, prune)) < least_worth:
            break
        rules.append(rule)
        left = [r for r in left if not all(t.holds(r) for t in rule)]
    return rules


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> list[Rule]:
    """Learns from at most max_rows labelled documents, those whose doc_id hashes lowest; quality 0 is bad.

    Rows with a null id, label or text are left out; without labels the list is empty.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")  # max_rows ids
    rows = counts(sample, keep=["quality"]).select("doc_id", "quality", *STATISTICS).collect()
    number = lambda i: i if isinstance(i, int) else zlib.crc32(str(i).encode())
    rows = sorted((r.asDict() for r in rows), key=lambda r: (number(r["doc_id"]) * 2654435761 % 2**32, r["doc_id"]))
    return learn_rules([r | {"bad": r["quality"] == 0} for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """One ordered conditional: the number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """counts() with base_failed, rule (number of the first rule that holds, or null) and kept.

    base_failed: under 50 words, or more than half of the words repeat. kept is false if
    base_failed, else whether no rule holds.
    """
    c = counts(docs, keep)
    c = c.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    c = c.withColumn("rule", verdict(rules))
    return c.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
