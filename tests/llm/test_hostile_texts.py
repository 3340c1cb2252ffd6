"""Very long and hostile texts: results in linear time, equal to plain versions where those can run."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import decontaminate, lattice, maintext, secrets, toxicity
from tallygrid.llm.textblock import text_bytes

#: Far above what a linear pass takes, far below what a quadratic one does.
SECONDS = 30


@pytest.fixture(autouse=True)
def clock():
    began = time.process_time()
    yield
    assert time.process_time() - began < SECONDS


@pytest.mark.parametrize(
    "page, size",
    [
        ("<a '" * 250_000, 1_000_000), ("<a '>'" * 170_000, 170_000), ("<" * 1_000_000, 1_000_000), ("<a " * 300_000 + "'>", 0),
        ("<!--" * 250_000, 0), ("<script>" * 120_000, 0), ("<a href='x" * 100_000 + ">", 0), ("</div>" * 150_000, 0),
        ("<div>" * 100_000 + "end", 3), ("<b" * 300_000 + ">", 0),
    ],
)
def test_pages_of_a_megabyte(page, size):
    assert len(maintext.page_text(page, {"w:": 1.0})) == size


def test_deep_sections_keep_their_innermost_weight():
    page = "<div>" * 50_000 + "<div class='good'>words of it</div>" + "</div>" * 50_000 + "<nav>menu</nav>"
    assert maintext.page_text(page, {"w:div": -1.0, "w:div.good": 3.0}) == "words of it"


@pytest.mark.parametrize("text", ["eyJ" * 350_000, "eyJa." * 200_000, "a. " * 300_000 + "eyJ", "a" * 1_000_000 + "eyJ", "password" + " " * 1_000_000, "-----BEGIN " * 90_000])
def test_secrets_of_a_megabyte(text):
    assert len(secrets.Scanner().spans(text)) in (0, 1, 1 + len(text) // 15)


def test_web_tokens_equal_their_pattern():
    rng, pattern = random.Random(1), re.compile(secrets.MORE["web"][0], re.ASCII)
    for _ in range(30_000):
        text = "".join(rng.choice(["eyJ", "a", ".", "-", " ", "eyJx.y", "é"]) for _ in range(rng.randrange(14)))
        assert list(secrets._web_tokens(text)) == [m.span() for m in pattern.finditer(text)]


def test_long_words_equal_the_table(monkeypatch):
    rng, pieces = random.Random(3), lattice.Pieces.load()
    log_p = np.log(pieces.first_weights)
    words = ["".join(rng.choice("aeinrst漢é▁") for _ in range(70)) for _ in range(4)]
    one = lattice.word_scores(words, pieces, log_p, np.arange(1, 5.0))
    monkeypatch.setattr(lattice, "LONG", 1 << 40)
    two = lattice.word_scores(words, pieces, log_p, np.arange(1, 5.0))
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
    monkeypatch.undo()
    assert np.isfinite(lattice.word_scores(["abcdefgh" * 125_000], pieces, log_p)).all()


def test_a_long_item(spark):
    item = " ".join(f"w{i * 7 % 991}x{i % 13}" for i in range(200))
    docs = spark.createDataFrame([(1, "a b c " + item), (2, item[:600]), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (None, item + " z"), (None, "one two three four five six")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.benchmark_leaks(docs, items).collect()}
    assert found == {(1, 1): 1.0, (1, None): pytest.approx(196 / 197)}


def test_one_toxic_window_decides_however_long_the_text():
    """The score of a text is that of its greatest window; all others add nothing."""
    params, rng = toxicity.initial(), random.Random(4)
    params = {k: v + np.random.default_rng(1).normal(0, 0.3, v.shape).astype(v.dtype) for k, v in params.items()}
    parts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(50)) for _ in range(60)) for _ in range(40)]
    score = lambda texts: toxicity.score_block(params, *text_bytes(pa.array(texts, pa.string())))
    ranked = sorted(parts, key=lambda t: score([t])[0])
    worst, clean = ranked[-1], " ".join(ranked[:1] * 300)
    base = f"{clean} {worst} {clean}"
    assert score([base])[0] > score([clean])[0]
    assert score([base + f" {clean}" * 20])[0] >= score([base])[0] - 1e-6
