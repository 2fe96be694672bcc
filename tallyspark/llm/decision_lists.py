"""Quality rules: a decision list learned by sequential covering, in DataFrame operations only.

Figures of each text are worked out in its row. Labelled rows are joined to theirs, each figure is
cut into bins at the labelled rows' quantiles, and rules for low quality are found one after
another: a rule grows by the threshold condition of the largest FOIL gain, read from one histogram
of (figure, bin, label) counts, on two thirds of the rows; it is cut back to the beginning that
does best on the other third; what it covers is taken out. The list becomes one ordered Spark
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.staging import settle

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: The shares and sizes that conditions compare, from the counts of :func:`figures`.
SHARES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / word_chars",
    "repeat_words": "n_repeat_words / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "distinct_words": "n_distinct_words / n_words",
    "upper": "n_upper / word_chars",
    "digits": "n_digits / word_chars",
    "marks": "n_marks / word_chars",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def figures(docs: DataFrame, into: str = "figures") -> DataFrame:
    """``docs`` with one struct column of counts over the whole ``text``: those of COUNTS (words
    found twice or more in three-word windows in n_repeat_words) and a few more. Null has no words.

    A column of that name is replaced. Windows are told apart by a 64-bit hash within one text.
    """
    names = [c for c in docs.columns if c != into]
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(*names, text.alias("_t"))
    words = F.array_remove(F.split(F.translate("_t", BLANK[1:], " " * 5), " "), "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = marked.select(*names, "_t", words.alias("_w"), lines.alias("_l"))
    step = step.select(*names, "_t", "_w", "_l", F.expr(
        "CASE WHEN size(_w) < 3 THEN array() ELSE sort_array(transform(sequence(0, size(_w) - 3), i -> "
        "named_struct('h', xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), 'i', i))) END").alias("_s"))
    step = step.select(*names, "_t", "_w", "_l", F.expr(
        "sort_array(transform(filter(transform(_s, (x, k) -> named_struct('i', x.i, 'r', coalesce(x.h = get(_s, k - 1).h, false) "
        "OR coalesce(x.h = get(_s, k + 1).h, false))), x -> x.r), x -> x.i))").alias("_r"))
    size = F.length("_t").cast("long")

    def without(letters: str) -> Column:
        return size - F.length(F.translate("_t", letters, ""))

    counts = {
        "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.translate("_t", BLANK, "")).cast("long"), "n_symbols": without(SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_lines": F.size("_l").cast("long"),
        "n_repeat_words": F.expr("aggregate(_r, named_struct('n', 0L, 'at', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.at), 'at', i), a -> a.n)"),
        "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"), "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": without("0123456789"), "n_marks": without("!?.,;:"),
    }
    return step.select(*names, F.struct(*(c.alias(n) for n, c in counts.items())).alias(into))


def base_failed(figure: str = "figures") -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col(f"{figure}.n_words") < 50) | (100 * F.col(f"{figure}.n_repeat_words") > 50 * F.col(f"{figure}.n_words"))


def shares(figure: str = "figures") -> dict[str, Column]:
    """The figures that conditions compare; those of a text without words are 0."""
    def field(name: str) -> Column:
        return F.col(f"{figure}.{name}").cast("double")

    out = {}
    for name, what in SHARES.items():
        top, _, below = what.partition(" / ")
        out[name] = F.when(field(below) > 0, field(top) / field(below)).otherwise(0.0) if below else field(top)
    return out


@dataclass(frozen=True)
class Condition:
    figure: str
    above: bool
    threshold: float

    def column(self, figure: str = "figures") -> Column:
        value = shares(figure)[self.figure]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.figure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def learn(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 4, bins: int = 32, least: int = 5,
          precision: float = 0.9) -> list[Rule]:
    """The ordered rules for rows of label 0 in ``labelled`` (figures, quality, doc_id).

    Rows with a null label are let be; without rows of label 0 there are no rules. ``least``: rows of
    label 0 that a rule must cover on the rows it is pruned on; ``precision``: their least share.
    The driver sees counts per (figure, bin) only. Cuts are sample-free approximate quantiles.
    """
    columns = shares()
    names = list(columns)
    at = [i / bins for i in range(1, bins)]
    known = labelled.where("quality IS NOT NULL")
    found = known.agg(*(F.percentile_approx(c, at, 1000).alias(n) for n, c in columns.items())).first()
    cuts = {n: sorted(set(found[n] or [])) for n in names}
    if not any(cuts.values()):
        return []

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.lit(cuts[name]), lambda edge: edge < columns[name])) if cuts[name] else F.lit(0)

    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0, "prune").otherwise("grow")
    rows = known.select(*(bin_of(n).alias(n) for n in names), part.alias("part"), (F.col("quality") == 0).cast("long").alias("low"))
    rows = settle(rows.groupBy(*names, "part").agg(F.sum("low").alias("p"), (F.count("*") - F.sum("low")).alias("n")), "labelled")

    def holds(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for name, above, k in rule:
            out = out & (F.col(name) > k if above else F.col(name) <= k)
        return out

    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            met = left.where((F.col("part") == "grow") & holds(rule))
            each = F.explode(F.array(*(F.struct(F.lit(n).alias("f"), F.col(n).alias("bin")) for n in names))).alias("x")
            counts = met.select("p", "n", each).groupBy("x.f", "x.bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
            best = _best(counts, {n: len(cuts[n]) for n in names})
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        seen = left.where("part = 'prune'").agg(*(F.sum(F.when(holds(rule[:k]), F.col(c)).otherwise(0)).alias(f"{c}{k}")
                                                  for k in range(1, len(rule) + 1) for c in "pn")).first()
        worth = [((seen[f"p{k}"] or 0) - (seen[f"n{k}"] or 0)) / max(1, (seen[f"p{k}"] or 0) + (seen[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        keep = max(range(len(rule)), key=lambda k: (worth[k], -k)) + 1
        p, n = seen[f"p{keep}"] or 0, seen[f"n{keep}"] or 0
        if p < least or p < precision * (p + n):
            break
        rule = rule[:keep]
        rules.append(tuple(Condition(name, above, cuts[name][k] if above else cuts[name][k]) for name, above, k in _tidy(rule)))
        left = left.where(~holds(rule))
    return rules


def _tidy(rule: list[tuple[str, bool, int]]) -> list[tuple[str, bool, int]]:
    """Of conditions on one side of one figure the tightest; bin > k is value > cut k."""
    tight: dict[tuple[str, bool], int] = {}
    for name, above, k in rule:
        old = tight.get((name, above), k)
        tight[name, above] = max(old, k) if above else min(old, k)
    return [(name, above, k) for (name, above), k in tight.items()]


def _best(counts, cut_counts: dict[str, int]) -> tuple[str, bool, int] | None:
    """The condition of the largest FOIL gain, by name, side and cut where gains tie."""
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for row in counts:
        table.setdefault(row["f"], {})[row["bin"]] = (row["p"], row["n"])
    best, most = None, 1e-9
    for name in sorted(table):
        total_p, total_n = (sum(v[i] for v in table[name].values()) for i in (0, 1))
        if not total_p or not total_n:
            return None
        was = log2(total_p / (total_p + total_n))
        p = n = 0
        for k in range(cut_counts[name]):
            here = table[name].get(k, (0, 0))
            p, n = p + here[0], n + here[1]
            for above, q, m in ((False, p, n), (True, total_p - p, total_n - n)):
                if q and (gain := q * (log2(q / (q + m)) - was)) > most:
                    best, most = (name, above, k), gain
    return best


def verdict(rules: list[Rule], figure: str = "figures") -> Column:
    """The first rule (from 1) that a row meets, else 0: an ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        met = F.lit(True)
        for condition in rule:
            met = met & condition.column(figure)
        out = F.when(met, k) if out is None else out.when(met, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], **how) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (doc_id, text), the counts of COUNTS, ``base_failed``,
    ``rule`` (the first rule met, 0: none) and ``kept``. Columns of ``keep`` with such names give way.

    ``labels`` has doc_id and quality (0 low, 1 good); ids that are null or labelled both ways are
    not learned from, rows of one id count each. Nothing is dropped: null and empty texts fail.
    """
    keep = [c for c in keep if c not in {*COUNTS, "base_failed", "rule", "kept", "figures"}]
    rows = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    held = figures(rows).select(*dict.fromkeys([*keep, "doc_id"]), "figures")
    held = settle(held, "figures")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    rules = learn(held.select("doc_id", "figures").join(known.select("doc_id", "quality"), "doc_id"), **how)
    rule = verdict(rules)
    return held.select(*keep, *(F.col(f"figures.{c}").alias(c) for c in COUNTS), base_failed().alias("base_failed"),
                       rule.alias("rule"), (~base_failed() & (rule == 0)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    own = [c for c in docs.columns if c != "text"]
    held = settle(docs.select(F.struct(*docs.columns).alias("_own"), "doc_id", "text").transform(
        lambda d: figures(d, "figures")).drop("doc_id", "text"), "figures") if own else docs
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    facts = held.select(F.col("_own.doc_id").alias("doc_id"), "figures")
    rules = learn(facts.join(known.select("doc_id", "quality"), "doc_id"), **how)
    return held.where(~base_failed() & (verdict(rules) == 0)).select("_own.*")
