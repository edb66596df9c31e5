from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from quillmetry.operators import peers


def test_similarity_of_a_dense_source(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{chr(97 + k)}" for k in rng.integers(0, 20, 12)) for _ in range(59)] + ["12 34"]
    docs = [(k, f"s{k % 2}", int(rng.integers(-5, 95)), t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in peers.self_similarity(spark.createDataFrame(docs, "doc_id int, source string, day bigint, text string")).collect()}
    words = {k: Counter(t.split()) if k < 59 else Counter() for k, _, _, t in docs}
    seen = 0
    for k, source, day, _ in docs:
        near = [j for j, s, d, _ in docs if s == source and day - 30 <= d < day]
        assert (k in got) == bool(near)
        if near:
            assert got[k].peers == len(near) and (got[k].similarity is None) == (len(near) < 5)
        if len(near) >= 5:
            seen += 1
            df = Counter(w for j in [k, *near] for w in words[j])
            v = {j: {w: c * (math.log((2 + len(near)) / (1 + df[w])) + 1) for w, c in words[j].items()} for j in [k, *near]}
            size = {j: math.sqrt(sum(x * x for x in v[j].values())) for j in v}
            total = sum(sum(x * v[j].get(w, 0) for w, x in v[k].items()) / (size[j] * size[k]) for j in near if size[j] and size[k])
            assert got[k].similarity == pytest.approx(total / len(near), rel=1e-9)
    assert seen > 20


def test_no_row_for_each_pair(spark):
    docs = spark.createDataFrame([(k, "s", k // 40, f"same words {chr(97 + k % 26)}") for k in range(1200)], "doc_id int, source string, day bigint, text string")
    plan = peers.self_similarity(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and peers.self_similarity(docs).filter("similarity > 0").count() == 1160
