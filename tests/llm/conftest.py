from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, one word, ties, clashing pieces, and one very long text."""
    draw = random.Random(5)
    words = ["".join(draw.choices(LETTERS, k=draw.randrange(2, 9))) for _ in range(300)]
    prose = [" ".join(draw.choices(words, k=draw.randrange(1, 200))) for _ in range(30)]
    return [None, "", " \n\t ", "x", "Ünï cödé \U0001F600 text", "a b c a b c a b c", "same\nsame\n\nsame \n", *prose, prose[0], prose[0],
            "call +1 (415) 555-0100 or +44 20 7946 0958, mail a.b@c.example.com_d@e.org; 10.0.0.1.2.3.4 999.1.1.1 4111 1111 1111 1111",
            "4111111111111111 4111-1111-1111-1112 ++1 234567890 0001.2.3.255 x@y @z.a a@b.c.d..e +1((((((((((9", "1" * 5000, "a@" * 3000 + "b.c",
            "<|endoftext|> it's we'll 'tis ''s don't   \n\n  end  ", " ".join(draw.choices(words, k=60_000)), "9 " * 4000]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    """The texts with ids, an extra column and names that operators use themselves."""
    rows = [(i * 3, t, "x", 7, None) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int, figures string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
