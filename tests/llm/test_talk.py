from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import quotes, window_lm
from tallyspark.plans.staging import settle


def by_hand(rows):
    """conv, turn, reply_to, thread, depth, said, passages, sources, for one row per turn."""
    out, parents, told = [], {}, {}
    for conv, turn, _, text in sorted(rows, key=lambda r: r[:2]):
        said, passages, last = [], [], None
        for line in re.split(r"\r\n|\r|\n", text or ""):
            mark = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            level = mark[0].count(">") if mark else 0
            body = line[mark.end():] if mark else line
            if not level:
                said.append(body)
            elif last == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
            last = level
        normal = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
        said = "\n".join(said).strip()
        passages = [(lv, normal("\n".join(b))) for lv, b in passages if "\n".join(b).strip()]
        earlier = sorted(t for c, t in told if c == conv)
        sources = [max((t for t in earlier if b in told[conv, t]), default=None) for _, b in passages]
        linked = [(lv, n, s) for n, ((lv, _), s) in enumerate(zip(passages, sources, strict=True)) if s is not None]
        parent = min(linked)[2] if linked else (earlier[-1] if earlier else None)
        root, depth = parents[conv, parent] if parent is not None else (turn, -1)
        parents[conv, turn] = (root, depth + 1)
        told[conv, turn] = {normal(u) for u in [said, *re.split(r"\n\s*\n", said), *said.split("\n")] if u.strip()}
        out.append((conv, turn, parent, root, depth + 1, said, len(passages), ",".join("-" if s is None else str(s) for s in sources)))
    return out


def test_quotes_as_by_hand(spark):
    draw = random.Random(3)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(25):
            own = "\n".join(" ".join(draw.choices(("Alpha", "beta", "gamma", "d"), k=4)) + f" {conv} {turn} {k}" for k in range(draw.randrange(0, 4)))
            text = own
            if said and draw.random() < 0.6:
                quoted = draw.choice(said)
                text = "\n".join(f"> {x.upper()}" for x in quoted.split("\n")) + "\n" + own
                if draw.random() < 0.4:
                    text = "\n".join(f">>  {x}" for x in draw.choice(said).split("\n")) + "\r\n" + text + "\n> nobody said"
            rows.append((conv, turn, draw.choice(("user", None)), text))
            said.append(own)
    rows += [(9, 0, "user", None), (9, 5, "user", ""), (9, 7, "user", "> \n>>\n"), (9, 9, "user", " > x\nx")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, said int").repartition(5)
    got = quotes.conversations(frame).collect()
    assert sorted((r["conv_id"], r["turn"], r["reply_to"], r["thread"], r["depth"], r["said"], r["n_passages"], r["sources"]) for r in got if True) == sorted(by_hand(rows))


def test_quotes_of_parts(spark):
    first = "one a\ntwo b\nthree c\nfour d\nfive e"
    rows = [(1, 0, "u", first), (1, 1, "u", "p q\nr s\n\nt u\n\nv w"), (1, 2, "u", "other"), (1, 3, "u", "> two b\n> three c\nyes"),
            (1, 4, "u", "> P q r\n> s\n>\n> t u\nno"), (1, 5, "u", "> four d\n> made up words here\nno"), (1, 6, "u", "> yes\n> no\n> no more of it\nx")]
    out = {r["turn"]: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[t]["reply_to"] for t in (3, 4, 5, 6)] == [0, 1, 4, 5]
    assert [out[t]["sources"] for t in (3, 4, 5, 6)] == ["0", "1", "-", "-"] and out[4]["thread"] == 0 and out[4]["depth"] == 2


def test_quotes_of_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, "user", "> x"), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 2, None, "> X \nyes")]
    out = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(out) == 5
    assert next(r for r in out if r["turn"] == 2).asDict() | {"formatted": ""} == {
        "conv_id": 1, "thread": 1, "depth": 1, "turn": 2, "reply_to": 1, "role": None, "said": "yes", "formatted": "", "n_passages": 1, "n_linked": 1, "sources": "1"}
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_gradient_takes_each_exponential_once(monkeypatch):
    draw, taken, exp = np.random.default_rng(4), [], np.exp
    net = window_lm.Network.fresh(draw.uniform(1, 50, window_lm.SIZE))
    target, around = draw.integers(0, window_lm.SIZE, 300), draw.integers(0, window_lm.SIZE + 1, (300, 4))
    monkeypatch.setattr(np, "exp", lambda x, *a, **how: taken.append(np.size(x)) or exp(x, *a, **how))
    net.gradient(target, around)
    assert sum(taken) == 300 * (window_lm.CLASSES + window_lm.SIZE // window_lm.CLASSES)


def test_gradient():
    draw = np.random.default_rng(0)
    net = window_lm.Network.fresh(draw.uniform(1, 50, window_lm.SIZE))
    target, around = draw.integers(0, window_lm.SIZE, 40), draw.integers(0, window_lm.SIZE + 1, (40, 4))
    slope = net.gradient(target, around)
    direction = draw.normal(0, 1, len(slope)) * (slope != 0)
    lower, upper = (-window_lm.Network(net.values + s * 1e-3 * direction).log_probabilities(target, around).mean() for s in (-1, 1))
    assert abs((upper - lower) / 2e-3 - slope @ direction) < 0.02 * abs(slope @ direction) + 1e-3


def test_probabilities_sum_to_one():
    net = window_lm.Network.fresh(np.arange(1, window_lm.SIZE + 1.0))
    every = np.arange(window_lm.SIZE)
    assert abs(np.exp(net.log_probabilities(every, np.tile([3, 4, 5, window_lm.SIZE], (window_lm.SIZE, 1)))).sum() - 1) < 1e-4


def test_scores(spark, docs, odd_texts, empty):
    rows = {r["doc_id"]: r for r in window_lm.score_documents(docs, ["doc_id", "n_words"]).collect()}
    for i, text in enumerate(odd_texts):
        assert rows[i * 3]["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert (rows[i * 3]["per_word"] is None) == (rows[i * 3]["n_words"] == 0)
    assert window_lm.score_documents(empty).count() == 0


def test_learns_order_beyond_frequency(spark):
    cycle = [f"w{k}" for k in range(20)]
    train = spark.createDataFrame([(i, " ".join((cycle * 30)[i % 20:i % 20 + 400])) for i in range(300)], "doc_id long, text string").repartition(4)
    train = settle(window_lm.keyed(train, []))
    numbers, counts = window_lm.vocabulary(window_lm.word_counts(train))
    start = window_lm.Network.fresh(counts)
    net = window_lm.train(train, numbers, start)
    words = (cycle * 5)[3:90]
    draw = random.Random(1)
    held = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(draw.sample(words, len(words))))], "doc_id long, text string")
    after = {r["doc_id"]: r["per_word"] for r in window_lm.scored(window_lm.keyed(held, ["doc_id"]), numbers, net).collect()}
    before = {r["doc_id"]: r["per_word"] for r in window_lm.scored(window_lm.keyed(held, ["doc_id"]), numbers, start).collect()}
    assert after[1] > before[1] + 1 and after[1] > after[2] + 1


def test_every_word_has_its_own_probability(spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(draw.choices(words, [1 / (k + 30) for k in range(3000)], k=300)) for _ in range(40)] + [None, "", "W0 w1 W2999"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)
    keyed = settle(window_lm.keyed(docs, ["_row"]))
    counted = settle(window_lm.word_counts(keyed))
    n, key = {}, {}
    for row in docs.join(keyed, "_row").collect():
        for word, k in zip((row["text"] or "").lower().split(), row["keys"], strict=True):
            n[word], key[word] = n.get(word, 0) + 1, k
    assert len(set(key.values())) == len(n) and {r["key"]: r["n"] for r in counted.collect()} == {key[w]: n[w] for w in n}
    known = window_lm.SIZE - window_lm.OTHERS
    top = sorted(n, key=lambda w: (-n[w], key[w]))[:known]
    numbers, found = window_lm.vocabulary(counted)
    assert list(numbers) == [key[w] for w in top]
    assert len(n) > 2 * known and any(n[w] > 1 for w in n.keys() - set(top))
    net = window_lm.train(keyed, numbers, window_lm.Network.fresh(found))
    held = docs.unionByName(spark.createDataFrame([(99, "w0 junk1 w1 junk2 w2999")], "_row long, text string"))
    of = window_lm.keyed(held.withColumn("also", F.col("text")), ["_row", "also"])
    for row in of.collect():
        key.update(zip((row["also"] or "").lower().split(), row["keys"], strict=True))
    got = {r["_row"]: r for r in window_lm.scored(of, numbers, net, counted).collect()}
    numbers = {w: k for k, w in enumerate(top)}
    group = lambda w: known + key[w] % window_lm.OTHERS
    whole = {}
    for word in n.keys() - numbers.keys():
        whole[group(word)] = whole.get(group(word), 0) + n[word]
    for row in held.collect():
        text = (row["text"] or "").lower().split()
        at = [numbers.get(w, group(w)) for w in text]
        padded = np.array([window_lm.SIZE] * 2 + at + [window_lm.SIZE] * 2)
        around = np.array([[padded[i + 2 + p] for p in window_lm.PLACES] for i in range(len(at))]).reshape(-1, 4)
        logs = net.log_probabilities(np.array(at, np.int64), around)
        own = [0 if w in numbers else math.log(n.get(w, 1) / (whole.get(group(w), 0) + 1)) for w in text]
        assert got[row["_row"]]["n_words"] == len(text)
        assert abs(got[row["_row"]]["log_likelihood"] - logs.sum() - sum(own)) < 0.01
        assert (got[row["_row"]]["per_word"] is None) == (not text)


def test_random_words_score_below_rare_ones(spark):
    draw = random.Random(6)
    rare = ["".join(draw.choices("abcdefghij", k=9)) for _ in range(4000)]
    texts = [" ".join(draw.choices(rare, k=60)) for _ in range(400)]
    junk = [" ".join("".join(draw.choices("klmnopqrst", k=9)) for _ in range(60)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts + junk + texts[:1])), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r["per_word"] for r in window_lm.score_documents(docs).collect()}
    real = [rows[k] for k in range(400)]
    assert max(rows[400 + k] for k in range(5)) < min(real)
    assert abs(rows[405] - rows[0]) < 1e-9
