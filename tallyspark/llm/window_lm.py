"""Language-model scores by masked pseudo-likelihood.

A small network sees the two words before and the two after a place and predicts the word there: one
embedding table per place of the window, their sum through tanh, then a class of words and a word
within it. The network's words are the SIZE - OTHERS most frequent ones of the whole corpus (lower
case, counted over all documents) and OTHERS groups of the rest by hash. A word of the rest has its
group's probability times its own share of the group, by a table of all words of the corpus with
their counts, joined by word. Each task trains on all its documents by Adagrad in numpy, from the same
start; the networks are averaged, weighted by the words they saw.
A document's score is the sum over its words of the log-probability of each given its neighbours.

Texts are cut once: a word is from then on a 64-bit hash of its code points, its key. Words are one
only if all 64 bits agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import spans
from tallyspark.llm.arrow import batches
from tallyspark.plans.staging import discard, settle, unused

SIZE, OTHERS, CLASSES, WIDTH = 1024, 32, 32, 16
PLACES = (-2, -1, 1, 2)
BATCH, RATE = 4096, 0.1
#: Words worked on at once, but for a longer text; words counted before they are handed on; parameters in a row of a task's network.
PART, HELD, BLOCK = 500_000, 4_000_000, 4096
_IN = SIZE // CLASSES
_COLUMNS = ("n_words", "log_likelihood", "per_word")


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` but text and those of the scores, and as the last column
    the key of each word of the whole text, in order. Null has none."""
    keep = [c for c in keep if c not in (*_COLUMNS, "text")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for chunk in spans.chunks(batch.column("text").to_pylist()):
                points, ends = spans.code_points([t.lower() for t in chunk])
                starts, stops, outside = spans.blank_words(points)
                keys.append(spans.hashes(points, starts, stops, outside)[0].view(np.int64))
                sizes.append(np.diff(np.searchsorted(starts, ends), prepend=0))
            yield pa.record_batch([*(batch.column(c) for c in keep), _lists(np.concatenate(keys), np.concatenate(sizes))], names=names)

    rows = docs.select(*keep, "text")
    names = [*keep, unused("keys", keep)]
    return rows.mapInArrow(run, T.StructType([*rows.drop("text").schema.fields, T.StructField(names[-1], T.ArrayType(T.LongType()))]))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys and words per text of some texts after the other, about PART words at once."""
    lists = batch.column(batch.num_columns - 1)
    edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + PART, side="right")) - 1)
        yield values[edges[at]:edges[to]], np.diff(edges[at:to + 1])
        at = to


def word_counts(words: DataFrame) -> DataFrame:
    """``key`` and ``n`` of every word of the :func:`keyed` rows ``words``."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, keys = pd.factorize(np.concatenate(held))
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(np.bincount(codes, minlength=len(keys)), pa.int64())], names=["key", "n"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parts:
            for keys, _ in _parts(batch):
                held.append(keys)
                size += len(keys)
                if size > HELD:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return words.select(words.columns[-1]).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[dict[int, int], np.ndarray]:
    """The number of each frequent word's key, by falling count, and the counts of all SIZE numbers."""
    top = counts.orderBy(F.desc("n"), "key").limit(SIZE - OTHERS).collect()
    numbers = {r["key"]: k for k, r in enumerate(top)}
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = np.ones(SIZE)
    found[:len(top)] += [r["n"] for r in top]
    found[SIZE - OTHERS:] += (total - sum(r["n"] for r in top)) / OTHERS
    return numbers, found


def rare_words(counts: DataFrame, numbers: dict[int, int]) -> tuple[DataFrame, np.ndarray]:
    """The rows of ``counts`` outside ``numbers``, and what each of the OTHERS groups holds in all."""
    rest = counts.where(~F.col("key").isin(list(numbers))) if numbers else counts
    totals = np.zeros(OTHERS)
    for row in rest.groupBy(F.pmod("key", F.lit(OTHERS)).alias("at")).agg(F.sum("n").alias("n")).collect():
        totals[row["at"]] = row["n"]
    return rest, totals


class Numbers:
    """Keys to numbers: a frequent word's own, or its group's. Groups are numbered from SIZE - OTHERS."""

    def __init__(self, numbers: dict[int, int]) -> None:
        self.keys = np.array(sorted(numbers), np.int64)
        self.numbers = np.array([numbers[k] for k in self.keys.tolist()], np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = SIZE - OTHERS + keys % OTHERS
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.numbers[at[known]]
        return out

    def windows(self, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number and the numbers around it, SIZE beyond its text."""
        target = self(keys)
        gap = len(PLACES) // 2
        at = np.arange(len(target)) + gap * (1 + np.repeat(np.arange(len(sizes)), sizes))
        padded = np.full(len(target) + gap * (len(sizes) + 2), SIZE, np.int64)
        padded[at] = target
        return target, np.stack([padded[at + p] for p in PLACES], axis=1)


class Network:
    """The parameters in one vector, and views of them."""

    SHAPES = {"inputs": (len(PLACES), SIZE + 1, WIDTH), "bias": (WIDTH,), "classes": (CLASSES, WIDTH), "class_bias": (CLASSES,),
              "words": (CLASSES, _IN, WIDTH), "word_bias": (CLASSES, _IN)}

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.astype(np.float32)
        self.parts = self._views(self.values)

    @classmethod
    def _views(cls, values: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[name] = values[at:at + n].reshape(shape)
            at += n
        return out

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; the biases say the corpus's word frequencies."""
        total = sum(int(np.prod(s)) for s in cls.SHAPES.values())
        net = cls(np.random.default_rng(seed).normal(0, 0.1, total))
        table = np.log(counts.reshape(CLASSES, _IN))
        by_class = np.log(counts.reshape(CLASSES, _IN).sum(axis=1) / counts.sum())
        net.parts["bias"][:] = 0
        net.parts["class_bias"][:] = by_class
        net.parts["word_bias"][:] = table - np.log(counts.reshape(CLASSES, _IN).sum(axis=1))[:, None]
        return net

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        inputs = self.parts["inputs"]
        return np.tanh(sum(inputs[p][around[:, p]] for p in range(len(PLACES))) + self.parts["bias"])

    def log_probabilities(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for at in range(0, len(target), BATCH):
            out[at:at + BATCH] = self._forward(target[at:at + BATCH], around[at:at + BATCH], np.float64)[0]
        return out

    def _forward(self, target: np.ndarray, around: np.ndarray, kind: type = np.float32):
        """Log-probabilities; and what the gradient needs: the places in order of their words' classes, where each class begins there,
        what is hidden at them, and all classes' and all words' probabilities, a column per place (in that order). Products in single
        precision (``kind``) follow in their last digit where a word stands in a batch."""
        order = np.argsort((target // _IN).astype(np.int16), kind="stable")
        target = target[order]
        group, own = target // _IN, np.arange(len(target))
        edges = np.searchsorted(group, np.arange(CLASSES + 1))
        hidden = self._hidden(around[order])
        across = np.ascontiguousarray(hidden.T, kind)
        classes = (self.parts["classes"].astype(kind, copy=False) @ across).astype(np.float32, copy=False) + self.parts["class_bias"][:, None]
        words = self.parts["words"].astype(kind, copy=False)
        inside = np.empty((_IN, len(target)), np.float32)
        for g in np.flatnonzero(np.diff(edges)):
            mine = slice(edges[g], edges[g + 1])
            inside[:, mine] = words[g] @ across[:, mine]
            inside[:, mine] += self.parts["word_bias"][g][:, None]
        out = np.empty(len(target), np.float32)
        out[order] = _softmax(classes, group, own) + _softmax(inside, target % _IN, own)
        return out, order, edges, hidden, classes, inside

    def gradient(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        n = len(target)
        _, order, edges, hidden, d_class, d_word = self._forward(target, around)
        target, around = target[order], around[order]
        own, out = np.arange(n), np.zeros_like(self.values)
        to = self._views(out)
        d_class[target // _IN, own] -= 1
        d_word[target % _IN, own] -= 1
        d_hidden = d_class.T @ self.parts["classes"]
        to["classes"][:] = d_class @ hidden
        to["class_bias"][:] = d_class.sum(axis=1)
        for g in np.flatnonzero(np.diff(edges)):
            mine = slice(edges[g], edges[g + 1])
            some = d_word[:, mine]
            to["words"][g] = some @ hidden[mine]
            to["word_bias"][g] = some.sum(axis=1)
            d_hidden[mine] += some.T @ self.parts["words"][g]
        d_in = d_hidden * (1 - hidden * hidden)
        to["bias"][:] = d_in.sum(axis=0)
        flat = d_in.astype(np.float64).ravel()
        cell = np.arange(WIDTH)
        for p in range(len(PLACES)):
            spot = (around[:, p, None] * WIDTH + cell).ravel()
            to["inputs"][p] = np.bincount(spot, flat, (SIZE + 1) * WIDTH).reshape(SIZE + 1, WIDTH)
        return out / n


def _softmax(x: np.ndarray, row: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Makes the columns of ``x`` probabilities, in place; the logarithm of the one at ``row`` of each column."""
    x -= x.max(axis=0)
    chosen = x[row, own]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    return chosen - np.log(total)


def train(words: DataFrame, numbers: dict[int, int], start: Network) -> Network:
    """One pass over all of the :func:`keyed` rows ``words``. What goes to the driver is one network."""
    begin = start.values

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, seen, table = Network(begin.copy()), 0, Numbers(numbers)
        square = np.full(len(begin), 1e-6, np.float32)
        for batch in parts:
            for keys, sizes in _parts(batch):
                target, around = table.windows(keys, sizes)
                for at in range(0, len(target), BATCH):
                    slope = net.gradient(target[at:at + BATCH], around[at:at + BATCH])
                    square += slope * slope
                    net.values -= np.float32(RATE) * slope / np.sqrt(square)
                seen += len(target)
        if seen:
            task = TaskContext.get().partitionId()
            rows = ((k, task % 64, seen, (net.values[at:at + BLOCK].astype(np.float64) * seen).tobytes()) for k, at in enumerate(range(0, len(begin), BLOCK)))
            yield from batches(rows, pa.schema([("block", pa.int32()), ("share", pa.int32()), ("words", pa.int64()), ("sums", pa.binary())]))

    def add(part: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(x, np.float64) for x in part["sums"])
        return pd.DataFrame({"block": part["block"].iloc[:1], "share": part["share"].iloc[:1], "words": [part["words"].sum()], "sums": [sums.tobytes()]})

    kind = "block int, share int, words long, sums binary"
    sums = words.select(words.columns[-1]).mapInArrow(run, kind).groupBy("block", "share").applyInPandas(add, kind)
    rows = sums.groupBy("block").applyInPandas(add, kind).collect()
    if not rows:
        return start
    rows.sort(key=lambda r: r["block"])
    return Network(np.concatenate([np.frombuffer(r["sums"], np.float64) / r["words"] for r in rows]))


def scored(words: DataFrame, numbers: dict[int, int], net: Network, counts: DataFrame | None = None) -> DataFrame:
    """The columns of every :func:`keyed` row of ``words`` but the last, ``n_words``, ``log_likelihood`` and
    ``per_word`` (null without words).

    ``counts``: the settled :func:`word_counts` that ``numbers`` come from. A word outside ``numbers`` that
    was counted n times has n / (N + 1) of its group's probability, N being all that the group holds;
    a word never seen has 1 / (N + 1). Without ``counts`` such a word scores as its whole group.
    """
    keep = words.columns[:-1]
    values = net.values
    rest, totals = (None, np.zeros(OTHERS)) if counts is None else rare_words(counts, numbers)
    whole = np.concatenate([np.zeros(SIZE - OTHERS), np.log(totals + 1)])
    given, row, more = (unused(name, keep) for name in ("_keys", "_row", "_more"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = Network(values), Numbers(numbers)
        for batch in parts:
            sums, rare, n_rare = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for keys, sizes in _parts(batch):
                target, around = table.windows(keys, sizes)
                owner, other = np.repeat(np.arange(len(sizes)), sizes), target >= SIZE - OTHERS
                sums.append(np.bincount(owner, held.log_probabilities(target, around) - whole[target], len(sizes)))
                rare.append(keys[other])
                n_rare.append(np.bincount(owner[other], minlength=len(sizes)))
            n = np.diff(batch.column(len(keep)).offsets.to_numpy())
            yield pa.record_batch([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(np.concatenate(sums)), _lists(np.concatenate(rare), np.concatenate(n_rare))],
                                  names=[*keep, "n_words", "log_likelihood", given])

    own = [T.StructField("n_words", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField(given, T.ArrayType(T.LongType()))]
    rows = words.mapInArrow(run, T.StructType([*words.schema.fields[:-1], *own]))
    if rest is not None:
        # No word outside the vocabulary makes up more than one in SIZE - OTHERS of all, so no key of this join is hot.
        rows = settle(rows.withColumn(row, F.monotonically_increasing_id()), "scores")
        each = rows.select(row, F.explode(given).alias("key")).join(rest.where("n > 1"), "key")
        sums = each.groupBy(row).agg(F.sum(F.log("n")).alias(more))
        rows = rows.drop(given).join(sums, row, "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce(more, F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return rows.select(*keep, "n_words", "log_likelihood", mean.alias("per_word"))


def score_documents(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts words and trains on all of ``docs`` (text), then scores every row: the columns ``keep`` (by
    default doc_id), n_words, log_likelihood, per_word. Null and empty texts have no words, a
    log_likelihood of 0 and a null per_word; repeated rows score alike; an empty table gives an empty
    one. Scores follow how rows are dealt to tasks in their last digits, since networks are averaged."""
    words = settle(keyed(docs, keep or ["doc_id"]), "words")
    counts = settle(word_counts(words), "word-counts")
    numbers, found = vocabulary(counts)
    out = scored(words, numbers, train(words, numbers, Network.fresh(found)), counts)
    discard(words)
    return out
