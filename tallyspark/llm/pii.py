"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four patterns find the base spans. All words between white space are instances; those that hold a
part of a base match are the seeds, where they do. An instance's context gives lexical patterns: the word before it,
the word after it, and both words, alone and with its shape. On the graph of patterns and instances a
pattern is worth the mean score of its instances; an instance has the mean of its contexts, each at
the worth of its best pattern. Seeds stay at 1; patterns with too few seeds say nothing for or
against, and those where seeds are rare speak against what stands in them. After a few rounds,
instances with a pattern of high worth and a high score of their own are personal data too, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.staging import attach, discard, fits, settle

#: Kinds in their order, and their patterns. A run of the leading class is tried from its first
#: letter only, and runs are possessive: the same matches without going back over long runs.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD, BLANKS = r"\S+", r"\s+"
FOUND = "context"
ROUNDS, LEAST_SEEDS, LEAST_SHARE, PATTERN_WORTH, INSTANCE_SCORE = 3, 5, 0.2, 0.9, 0.8
#: Keys up to this many are written into a condition, more are joined.
FEW = 10_000
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _sums(lengths: str, block: int = 256) -> str:
    """SQL: the running sums of an array of ints, a block at a time, so that long arrays are not
    copied once per element."""
    small = f"aggregate(slice({lengths}, b * {block} + 1, {block}), array(a.s), (x, v) -> array_append(x, element_at(x, -1) + v))"
    return (f"flatten(aggregate(sequence(0, (size({lengths}) - 1) div {block}), named_struct('s', 0, 'o', CAST(array() AS array<array<int>>)), (a, b) -> "
            f"named_struct('s', a.s + aggregate(slice({lengths}, b * {block} + 1, {block}), 0, (x, v) -> x + v), "
            f"'o', array_append(a.o, slice({small}, 2, {block}))), a -> a.o))")


def _places(df: DataFrame, name: str, pattern: str | Column, needs: str) -> DataFrame:
    """``df`` (with _t) and ``name``: an array of (start, end, word) of the matches in order, in code points."""
    lit = F.lit(pattern)
    match, gap, length, total = (f"_{name}_{x}" for x in ("m", "g", "l", "p"))
    has = F.col("_t").rlike(needs)
    df = df.withColumn(match, F.when(has, F.regexp_extract_all("_t", lit, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gap, F.when(F.size(match) > 0, F.split("_t", pattern)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(length, F.expr(f"flatten(transform({match}, (m, k) -> array(length(get({gap}, k)), length(m))))"))
    df = df.withColumn(total, F.expr(f"CASE WHEN size({match}) = 0 THEN CAST(array() AS array<int>) ELSE {_sums(length)} END"))
    df = df.withColumn(name, F.expr(
        f"transform({match}, (m, k) -> named_struct('start', get({total}, 2 * k), 'end', get({total}, 2 * k + 1), 'word', m))"))
    return df.drop(match, gap, length, total)


def _valid(kind: str, word: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(word, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.translate(word, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(word, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _shape(word: Column) -> Column:
    letters = F.regexp_replace(F.regexp_replace(word, r"\p{L}+", "a"), "[0-9]+", "9")
    return F.when(F.length(letters) <= 40, letters).otherwise("long")


def _of_kind(rank: int, kind: str) -> Column:
    good = F.filter(f"_{kind}", lambda s: _valid(kind, s["word"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, and per row ``text`` and the array ``base`` of valid spans by start and kind."""
    step = docs.select(*dict.fromkeys([*keep, "text"]), F.coalesce("text", F.lit("")).alias("_t"))
    for kind, pattern in KINDS.items():
        step = _places(step, f"_{kind}", pattern, NEEDS[kind])
    spans = [_of_kind(rank, kind) for rank, kind in enumerate(KINDS)]
    return step.select(*dict.fromkeys([*keep, "text"]), F.sort_array(F.concat(*spans)).cast(_SPAN).alias("base"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _nth_words(span: Column) -> Column:
    """The numbers, from 0, of the words of ``text`` that hold a part of ``span``; a span begins and ends within words."""
    first, last = (F.regexp_count(F.substring("text", F.lit(1), upto), F.lit(WORD)) - 1 for upto in (span["start"] + 1, span["end"]))
    return F.sequence(first, last)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once a row, however often and inside whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def occurrences(rows: DataFrame, wanted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word``, ``seed`` (whether it holds part of a base span there), ``before`` and ``after`` (in lower case, empty at an
    end of the text) of the words of ``rows`` (text, base). ``wanted``, of a row's words as an array of structs (word, low) and a place
    in it, leaves out words before they become rows."""
    words = F.transform(F.filter(F.split("text", BLANKS), lambda w: w != ""), lambda w: F.struct(w.alias("word"), F.lower(w).alias("low")))
    seeds = F.when(F.size("base") > 0, F.array_distinct(F.flatten(F.transform("base", _nth_words)))).otherwise(F.array().cast("array<int>"))

    def kept(s: Column, n: Column) -> Column:
        every = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        some = every if wanted is None else F.filter(every, lambda k: wanted(s, k))
        return F.transform(some, lambda k: F.struct(
            F.get(s, k)["word"].alias("word"), F.array_contains(n, k).alias("seed"),
            F.coalesce(F.get(s, k - 1)["low"], F.lit("")).alias("before"), F.coalesce(F.get(s, k + 1)["low"], F.lit("")).alias("after")))

    held = rows.where(F.length("text") > 0).select(_let(F.struct(words.alias("s"), seeds.alias("n")), lambda v: kept(v["s"], v["n"])).alias("_x"))
    # outer: what explode drops would be filtered by the array written out, inside its own lambda too
    return held.select(F.explode_outer("_x").alias("x")).select("x.*").where("word IS NOT NULL")


def _patterns() -> Column:
    """The hashes of an occurrence's patterns: the word before, the word after and both, each of them
    alone and, for words with a digit, with the word's shape."""
    sides = (("before", ["before"]), ("after", ["after"]), ("both", ["before", "after"]))
    plain = [F.xxhash64(F.lit(name), *cols) for name, cols in sides]
    shaped = [F.xxhash64(F.lit(name), *cols, _shape(F.col("word"))) for name, cols in sides]
    return F.when(F.col("word").rlike("[0-9]"), F.array(*plain, *shaped)).otherwise(F.array(*plain))


def _side(name: str, word: Column) -> Column:
    """The hash of the pattern of one word before or after, alone: the first two of _patterns."""
    return F.xxhash64(F.lit(name), word)


def _few(keys: DataFrame, column: str) -> list[int] | None:
    """The keys, where they are few enough to be written into a condition; their number is measured."""
    return [r[0] for r in keys.select(column).collect()] if keys.count() <= FEW else None


def _standing(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """The occurrences that have a word of ``sides`` (pattern: hashes of words before or after, alone) beside them. Few such words are
    looked for in each text before its words become rows; many are joined to the rows."""
    few = _few(sides, "pattern")
    if few is not None:
        def beside(s: Column, k: Column) -> Column:
            low = lambda at: F.coalesce(F.get(s, at)["low"], F.lit(""))
            return _side("before", low(k - 1)).isin(few) | _side("after", low(k + 1)).isin(few)
        return occurrences(rows, beside)
    found, small = occurrences(rows), fits(sides)
    for side in ("before", "after"):
        names = sides.select(F.col("pattern").alias("_key"), F.lit(True).alias(f"_{side}"))
        found = attach(found.withColumn("_key", _side(side, F.col(side))), names, ["_key"], spread="word", small=small).drop("_key")
    return found.where("_before OR _after").drop("_before", "_after")


def _of_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The occurrences of ``words`` (word), found the same way."""
    few = _few(words.select(F.xxhash64("word").alias("key")), "key")
    if few is not None:
        return occurrences(rows, lambda s, k: F.xxhash64(F.get(s, k)["word"]).isin(few)).join(words, "word", "left_semi")
    return attach(occurrences(rows), words, ["word"], "inner", spread="after")


def discovered(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``word`` of those of ``rows`` (text, base) that the contexts give away where they are no seeds, settled.

    Patterns with LEAST_SEEDS different seeds are evidence. Of them those lead where seeds are LEAST_SHARE of what stands in them; only words
    that stand in one that leads can be found, and the graph is that of these words and all their patterns. Patterns that lead are worth
    the mean score of their words, seeds at 1; the others their share of seeds, so that they speak against a word. A context counts as its
    worthiest pattern, a context without one does not count, and a word's score is the mean of its contexts. ``rounds`` is how far scores
    spread: a slot's unseen words are found after three while seeds are over about 54% of its words."""
    mine = occurrences(rows.where(F.size("base") > 0)).where("seed").select("word", F.explode_outer(_patterns()).alias("pattern"))
    seeds = settle(mine.groupBy("pattern").agg(F.count_distinct("word").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS), "seed-patterns")
    stages = [seeds]

    def kept(df: DataFrame, name: str) -> DataFrame:
        stages.append(settle(df, name))
        return stages[-1]

    small = fits(seeds)
    # what stands in a pattern with seeds stands in that of its word before or after alone
    each = _standing(rows, seeds).select("seed", F.explode_outer(_patterns()).alias("pattern"))
    shares = attach(each, seeds, ["pattern"], "inner", spread="seed", small=small).groupBy("pattern").agg(
        F.first("seeds").alias("seeds"), F.avg(F.col("seed").cast("double")).alias("share"))
    shares = kept(shares, "shares")
    leads = kept(shares.where(F.col("share") >= LEAST_SHARE).select("pattern"), "leads")
    found = settle(rows.sparkSession.createDataFrame([], "word string"), "found")
    if not leads.isEmpty():
        near = _standing(rows, _lead_sides(rows, leads, seeds)).where("NOT seed").select("word", F.explode_outer(_patterns()).alias("pattern"))
        words = kept(attach(near, leads, ["pattern"], "inner", spread="word", small=fits(leads)).select("word").distinct(), "words")
        contexts = _of_words(rows, words).where("NOT seed").select("word", "before", "after").distinct()
        edges = contexts.select("word", F.xxhash64("before", "after").alias("context"), F.explode_outer(_patterns()).alias("pattern"))
        edges = kept(attach(edges, shares.select("pattern"), ["pattern"], "inner", spread="word", small=small), "contexts")
        pairs = kept(attach(edges.select("word", "pattern").distinct(), leads, ["pattern"], "inner", spread="word", small=fits(leads)), "pairs")
        score = kept(pairs.groupBy("word").agg(F.lit(0.0).alias("score"), F.lit(0.0).alias("best")), "scores")
        for _ in range(rounds):
            others = attach(pairs, score, ["word"], spread="pattern").groupBy("pattern").agg(F.sum("score").alias("more"), F.count("*").alias("n"))
            leading = (F.col("seeds") + F.col("more")) / (F.col("seeds") + F.col("n") + 1)
            worth = kept(shares.join(others, "pattern", "left").select("pattern", F.coalesce(leading, "share").alias("worth")), "patterns")
            by = attach(edges, worth, ["pattern"], spread="word").groupBy("word", "context").agg(F.max("worth").alias("worth"))
            score = kept(by.groupBy("word").agg(F.avg("worth").alias("score"), F.max("worth").alias("best")), "scores")
        found = settle(score.where((F.col("best") >= PATTERN_WORTH) & (F.col("score") >= INSTANCE_SCORE)).select("word"), "found")
    discard(*stages)
    return found


def _lead_sides(rows: DataFrame, leads: DataFrame, seeds: DataFrame) -> DataFrame:
    """The single-sided patterns (settled) beside seeds that stand in a pattern of ``leads``: every word in one has one of them beside it."""
    sides = occurrences(rows.where(F.size("base") > 0)).where("seed")
    each = sides.select(F.explode_outer(_patterns()).alias("pattern"), F.array(_side("before", F.col("before")), _side("after", F.col("after"))).alias("_sides"))
    beside = attach(each, leads, ["pattern"], "inner", spread="_sides", small=fits(leads)).select(F.explode_outer("_sides").alias("pattern")).distinct()
    return settle(attach(beside, seeds.select("pattern"), ["pattern"], "inner", spread="pattern"), "sides")


def _found(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` (_row, keep, text, base) with ``extra``, the spans the contexts add."""
    words, none = discovered(rows), F.array().cast(_SPAN)
    if words.isEmpty():
        return rows.select("_row", *keep, "base", none.alias("extra"))
    few = _few(words.select(F.xxhash64("word").alias("key")), "key")
    each = F.array_distinct(F.split("text", BLANKS))
    if few is not None:
        each = F.filter(each, lambda w: F.xxhash64(w).isin(few))
    has = rows.where(F.length("text") > 0).select("_row", F.explode_outer(each).alias("word")).where("word IS NOT NULL")
    has = has.join(F.broadcast(words) if fits(words) else words, "word", "left_semi").groupBy("_row").agg(F.collect_set("word").alias("_has"))
    # only the rows that hold such a word are read for its places
    some = rows.select("_row", F.col("text").alias("_t"), "base").join(settle(has, "holding"), "_row")
    literal = F.transform("_has", lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit("\\E")))
    some = _places(some, "_words", F.concat(F.lit(r"(?<!\S)(?:"), F.array_join(literal, "|"), F.lit(r")(?!\S)")), ".")
    apart = F.filter("_words", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    extra = some.select("_row", F.transform(apart, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit(FOUND).alias("kind"))).alias("extra"))
    return rows.join(extra, "_row", "left").select("_row", *keep, "base", F.coalesce("extra", none).alias("extra"))


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default doc_id) of every row of ``docs`` (text), and n_email, n_ip,
    n_card, n_phone, base_sha256, spans. Columns of ``keep`` with such names give way. A null or
    empty text has no spans; repeated rows come back each; an empty table gives an empty one."""
    keep = [c for c in keep or ["doc_id"] if c not in {"spans", "base_sha256", *(f"n_{k}" for k in KINDS)}]
    own = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(a) for c, a in own.items()], "text")
    rows = settle(base_spans(numbered, ["_row", *own.values()]), "spans")
    counts = [_count(kind) for kind in KINDS]
    return _found(rows, list(own.values())).select(
        *[F.col(a).alias(c) for c, a in own.items()], *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("base", "extra"))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts as its kind in brackets, and n_chars, where there is one,
    to match. Spans that overlap become one, under the first one's kind. Null and empty texts stay as they are, repeated
    rows come back each, other columns are let be whatever their names, an empty table gives an empty one."""
    own = {c: f"_keep_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "text", *[F.col(c).alias(a) for c, a in own.items()])
    rows = settle(base_spans(numbered, ["_row", *own.values()]), "spans")
    spans = _found(rows.select("_row", "text", "base"), [])
    spans = spans.select("_row", F.sort_array(F.concat("base", "extra")).alias("_spans")).where(F.size("_spans") > 0)
    apart = F.expr(
        "aggregate(_spans, CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string>>), (a, s) -> CASE "
        "WHEN size(a) > 0 AND s.start < element_at(a, -1).end THEN array_append(slice(a, 1, size(a) - 1), named_struct("
        "'start', element_at(a, -1).start, 'rank', element_at(a, -1).rank, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind)) "
        "ELSE array_append(a, s) END)")
    spans = spans.select("_row", apart.alias("_spans"))
    told = F.expr("concat(array_join(transform(_spans, (s, k) -> concat(substring(text, coalesce(get(_spans, k - 1).end, 0) + 1, "
                  "s.start - coalesce(get(_spans, k - 1).end, 0)), '[', upper(s.kind), ']')), ''), substring(text, element_at(_spans, -1).end + 1))")
    out = rows.drop("base").join(spans, "_row", "left").withColumn("text", F.when(F.col("_spans").isNotNull(), told).otherwise(F.col("text")))
    if "n_chars" in own:
        here = own["n_chars"]
        out = out.withColumn(here, F.when(F.col("_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(here)))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
