from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from quillmetry.llm import repetition as rp
from quillmetry.llm import textkit as tk


def brute(text: str | None) -> tuple[int, int]:
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, flag = set(), [0] * len(w)
    for i in range(len(w) - 3):
        k = tuple(w[i : i + 4])
        if k in seen:
            flag[i : i + 4] = [1] * 4
        seen.add(k)
    return len(w), sum(flag)


def corpus() -> list[str | None]:
    rng = np.random.default_rng(2)
    words = ["alpha", "Beta", "γάμμα", "don't", "42", "été", "日本", "x_y"]
    texts: list[str | None] = [None, "", "   \n\n", "one", "a b c d a b c d", "\n".join(["same old line again"] * 50), "😀 " * 400]
    for _ in range(120):
        lines = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(rng.integers(1, 9))]
        texts.append("\n".join(lines + lines[: rng.integers(0, len(lines) + 1)]))
    return texts


def test_counts_are_exact():
    texts = corpus()
    got = rp.repetition_of(pa.array(texts, pa.string()))
    assert list(zip(got["n_words"].tolist(), got["n_repeated"].tolist())) == [brute(t) for t in texts]


def paths(n):
    return itertools.product((0, 1), repeat=n)


def score(crf, x, y):
    return sum(g for g, b in zip(x @ crf.emission, y) if b) + sum(crf.chain[a, b] for a, b in zip(y, y[1:]))


def random_lines(rng, n):
    return rp.line_features(rng.random(n), rng.random(n), rng.random(n) < 0.5, rng.random(n), rng.integers(0, 80, n))


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    crf = rp.LineCrf(rng.normal(size=rp.N_FEATURES), rng.normal(size=(2, 2)))
    sizes = [3, 1, 7, 5]
    x, doc = random_lines(rng, sum(sizes)), np.repeat(np.arange(4), sizes)
    got = crf.decode(x, doc)
    for d, n in enumerate(sizes):
        part = x[doc == d]
        assert abs(score(crf, part, got[doc == d].astype(int).tolist()) - max(score(crf, part, y) for y in paths(n))) < 1e-9


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    crf = rp.LineCrf(rng.normal(size=rp.N_FEATURES), rng.normal(size=(2, 2)))
    sizes = [4, 6, 1]
    x, doc = random_lines(rng, sum(sizes)), np.repeat(np.arange(3), sizes)
    total, p, moves = crf.expected(x, doc)
    want, want_p, want_moves = 0.0, [], np.zeros((2, 2))
    for d, n in enumerate(sizes):
        weights = {y: np.exp(score(crf, x[doc == d], y)) for y in paths(n)}
        z = sum(weights.values())
        want += np.log(z)
        want_p += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_moves[a, b] += w / z
    assert total == pytest.approx(want) and p == pytest.approx(want_p) and moves == pytest.approx(want_moves)


def looping_corpus(rng, n):
    """Stories of distinct lines, a third of them with a stretch of lines that repeat in part."""
    out = []
    for i in range(n):
        lines = [" ".join(f"w{rng.integers(0, 4000)}" for _ in range(rng.integers(6, 25))) for _ in range(10)]
        if i % 3 == 0:
            for k in range(4, 9):
                lines[k] = " ".join([*lines[3].split()[: rng.integers(4, 9)], *lines[k].split()[: rng.integers(0, 14)]])
        out.append("\n".join(lines))
    return pa.array(out)


def test_fitted_field_on_lines_held_out():
    rng = np.random.default_rng(1)
    train, held = rp.lines_of(looping_corpus(rng, 150)), rp.lines_of(looping_corpus(rng, 150))
    crf = rp.fit_crf(train.x, train.doc, rp.labels_of(train))
    label = rp.labels_of(held)
    accuracy = lambda c: (c.decode(held.x, held.doc) == label).mean()
    assert accuracy(crf) > 0.97
    assert accuracy(crf) > accuracy(rp.LineCrf(crf.emission, np.zeros((2, 2))))  # the chain adds to what each line shows


def test_chain_and_content_share_decide(spark):
    rng = np.random.default_rng(5)
    texts = looping_corpus(rng, 60).to_pylist()
    df = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "src string, id string, text string")
    x, doc = random_lines(rng, 2000), np.repeat(np.arange(200), 10)
    alone = rp.LineCrf(rp.DEFAULT_CRF.emission, np.zeros((2, 2)))
    assert (alone.decode(x, doc) != rp.DEFAULT_CRF.decode(x, doc)).mean() > 0.01
    want = {str(i) for i, t in enumerate(texts) if (c := brute(t))[1] >= 0.25 * c[0]}
    assert want and {r.id for r in rp.found_repetition(df).collect()} == want
    nothing = rp.LineCrf(np.full(rp.N_FEATURES, -1.0), np.zeros((2, 2)))
    assert rp.found_repetition(df, crf=nothing).count() == 0


def test_query_edges(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "", 1), ("b", "x y z w " * 9, 1), ("b", "x y z w " * 9, 1)], "id string, text string, n_words int").selectExpr("'t' as src", "*")
    assert [(r.src, r.id) for r in rp.found_repetition(df).collect()] == [("t", "b")]
    assert rp.found_repetition(df.limit(0)).count() == 0


def test_hashes_agree_between_batches():
    a, b = tk.words_of(pa.array(["Hello wide world"])), tk.words_of(pa.array(["x", "say HELLO, world"]))
    assert a.hash[0] == b.hash[2] and a.hash[2] == b.hash[3] and a.hash[0] != a.hash[1]
