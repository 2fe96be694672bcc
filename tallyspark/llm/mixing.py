"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key, -ln(u) / weight, its u a hash of the seed, the id and the text. Within a
source documents are sorted by key; a document's place is the sum of the sizes ahead of it. A source's
target is met by complete epochs first; what is left of it is the words of the first places, so a
document of twice the weight is about twice as likely to be among them.

The order is global within a source, yet no task sorts a whole source: keys are cut into slices of
equal width in ln(key). A key's density there is at most 1 / e whatever its weight, so a slice of width
1 / r holds at most about 0.37 / r of a source's rows, and r follows the number of rows. A slice's place is
a running sum over the slices' totals, a document's place that plus a running sum inside its slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.staging import attach, beside, fits, settle

WORDS, BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
SHARES, SHARE_OF_ALL, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Rows of one slice of a source, about; the least weight of a document.
SLICE_ROWS, LEAST_WEIGHT = 100_000, 0.05
MADE = ("size", "source_size", "target", "epochs", "place", "taken")


def letter_share(text: Column) -> Column:
    """A document's quality weight where no other is given: letters among what is not blank, LEAST_WEIGHT at least."""
    letters, marks = (F.length(F.regexp_replace(text, x, "")) for x in (r"[^\p{L}]+", BLANKS))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), letters / F.when(marks > 0, marks)), F.lit(LEAST_WEIGHT))


def exponential_key(weight: Column, seed: str, *identity: Column) -> Column:
    """-ln(u) / weight; u, inside (0, 1), is 52 bits of the md5 of the seed and ``identity``."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *identity))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / weight


def source_targets(rows: DataFrame, shares: Sequence[int] = SHARES, share_of_all: float = SHARE_OF_ALL, most: int = MOST) -> DataFrame:
    """One row per source of ``rows`` (source, size): source, source_no, source_size, target, epochs and rest.

    Sources in code point order, null last, weigh ``shares``, repeating, and share ``share_of_all`` of all
    sizes. No target is above ``most`` times its source's size; what that leaves over goes to the others by
    weight, until none is above. That is one level, target = least(cap, level * weight): sources are sorted by
    cap / weight, and the level is set by the first one that is not above its cap once all before it are.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sums.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (F.pmod(F.col("source_no") - 1, F.lit(len(shares))) + 1).cast("int"))
    ordered = settle(ordered.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most), "sources")
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "source_no")
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    levels = ordered.select("_cap", "_weight", F.row_number().over(by_cap).alias("_at"), F.sum("source_size").over(Window.partitionBy()).alias("_all"),
                            before.alias("_before"), after.alias("_after"))
    levels = levels.withColumn("_level", (F.col("_all") * share_of_all - F.col("_before")) / F.col("_after"))
    level = levels.where(F.col("_level") * F.col("_weight") <= F.col("_cap")).agg(F.min_by("_level", "_at").alias("_level"))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight"))
    words = F.floor(F.col("target") + 0.5)
    return (beside(ordered, level).withColumn("target", F.coalesce(target, F.col("_cap").cast("double")))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("rest", (words - F.col("epochs") * F.col("source_size")).cast("long"))
            .select("source", "source_no", "source_size", "target", "epochs", "rest"))


def mixed(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weight: Column | None = None, source: str = "source", seed: str = SEED,
          shares: Sequence[int] = SHARES, share_of_all: float = SHARE_OF_ALL, most: int = MOST) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, and the column ``source``) the columns ``keep`` and size (its words), source_size,
    target (its source's), epochs (complete ones), place (words of its source ahead of it) and taken (its words
    in the mix, repeats counted). ``weight`` is a positive column, by default letter_share of the text.

    A source's taken words add up to its target, rounded: the document in which the rest of the target ends
    gives its first words only. Null and empty texts have size 0 and are never taken; a null source is one of its own, after the
    others; null ids and repeated rows are rows like others, rows equal in id and text being interchangeable; a null
    or non-positive weight is LEAST_WEIGHT. An empty table gives an empty one. ``keep`` columns named like results give way.
    """
    keep = [c for c in keep if c not in MADE and not c.startswith("_mix_")]
    text = F.col("text")
    weigh = letter_share(text) if weight is None else weight
    weigh = F.when(weigh > 0, weigh).otherwise(LEAST_WEIGHT)
    key = exponential_key(weigh.cast("double"), seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    own = [F.col(c).alias(f"_mix_{i}") for i, c in enumerate(keep)]
    rows = settle(docs.select(*own, F.col(source).alias("source"), F.col("doc_id").alias("_id"), size.alias("size"), key.alias("_key")), "sizes")
    # the count comes from the files' footers
    width = max(64, -(-rows.count() // SLICE_ROWS))
    rows = rows.withColumn("_slice", F.floor(F.log("_key") * width))
    targets = settle(source_targets(rows, shares, share_of_all, most), "targets")
    named = attach(rows, targets, ["source"], spread="_key")
    sums = named.groupBy("source_no", "_slice").agg(F.sum("size").alias("_in"))
    ahead = Window.partitionBy("source_no").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = settle(sums.select("source_no", "_slice", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_ahead")), "slices")
    inside = Window.partitionBy("source_no", "_slice").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(slices) if fits(slices) else slices, ["source_no", "_slice"]).withColumn("place", F.col("_ahead") + F.col("_inside"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("place")))
    placed = placed.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return placed.select(*[F.col(f"_mix_{i}").alias(c) for i, c in enumerate(keep)], *MADE)


def copies(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, with ``epoch`` (from 1) in place of an older column
    of that name; the text of a part is its first words with the blanks ahead of them. Other settings as in ``mixed``,
    and so are nulls, repeats and empty tables."""
    names = [c for c in docs.columns if c != "epoch"]
    row = next(f"_row{i}" for i in range(len(names) + 1) if f"_row{i}" not in names)
    rows = settle(docs.select(*names, F.monotonically_increasing_id().alias(row)), "mix")
    taken = mixed(rows, [row], **how).where("taken > 0").select(F.col(row), "size", "taken")
    taken = taken.withColumnsRenamed({"size": "_mix_size", "taken": "_mix_taken"})
    times = F.ceil(F.col("_mix_taken") / F.col("_mix_size"))
    each = rows.join(taken, row).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    left = F.col("_mix_taken") - (F.col("epoch") - 1) * F.col("_mix_size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left.cast("int")), "")
    return each.withColumn("text", F.when(left < F.col("_mix_size"), first).otherwise(F.col("text"))).select(*names, "epoch")


#: The same rows in DuckDB: one sorted window per source in place of slices.
ORACLE = rf"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
           md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest,
           coalesce(greatest({LEAST_WEIGHT}::DOUBLE, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g'))::DOUBLE
                             / nullif(length(regexp_replace(text, '{BLANKS}', '', 'g')), 0)), {LEAST_WEIGHT}::DOUBLE) AS weight
    FROM documents),
keyed AS (SELECT *, -ln((('0x' || substr(digest, 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE) / weight AS k FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sums),
capped AS (SELECT *, ([3, 1, 2])[(no - 1) % 3 + 1]::DOUBLE AS w, source_size * 2 AS cap FROM numbered),
levels AS (
    SELECT *, row_number() OVER (ORDER BY cap / w, no) AS nth,
           (sum(source_size) OVER () * 1.5::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (
    SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT min_by(level, nth) FROM levels WHERE level * w <= cap) * w), cap::DOUBLE) AS target
    FROM levels),
budgets AS (
    SELECT *, floor(target + 0.5)::BIGINT AS words,
           CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
    SELECT keyed.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM keyed)
SELECT p.doc_id, p.size, b.source_size, b.target, b.epochs, p.place,
       (b.epochs * p.size + greatest(0, least(p.size, b.words - b.epochs * b.source_size - p.place)))::BIGINT AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""
