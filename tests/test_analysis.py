"""Ranks and corrections, series analysis, artifacts and documents against brute force and fixed values."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmetry import runtime
from quillmetry.functions import special
from quillmetry.operators import analysis as an
from quillmetry.operators import changepoints as cp
from quillmetry.operators import documents as docs
from quillmetry.operators import drift, ranks
from quillmetry.operators import embeddings as em
from quillmetry.operators import fingerprints as fp
from quillmetry.sources import artifacts as art
from quillmetry.streaming import streams
from quillmetry.streaming.changepoints import Online, online_breaks

# ---- ranks and corrections ----


def brute_bh(p: list[float]) -> list[float]:
    n, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    out, low = [0.0] * n, 1.0
    for rank in range(n, 0, -1):
        low = min(low, p[order[rank - 1]] * n / rank)
        out[order[rank - 1]] = low
    return out


def test_corrections_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", float(rng.choice([0.01, 0.02, 0.5, 1.0, rng.random()]))) for i in range(400)]
    df = spark.createDataFrame([*rows, (1000, "hot", None), (1001, None, 0.03)], "id int, fam string, p double")
    got = {r.id: r.q for r in ranks.benjamini_hochberg(df, "p", "id").collect()}
    known = [(i, p) for i, _, p in [*rows, (1001, None, 0.03)]]
    want = dict(zip([i for i, _ in known], brute_bh([p for _, p in known])))
    assert got.pop(1000) is None and got == pytest.approx(want)
    got = {r.id: r.q for r in ranks.benjamini_hochberg(df, "p", "id", ["fam"]).collect()}
    for fam in {f for _, f, _ in rows}:
        mine = [(i, p) for i, f, p in rows if f == fam]
        assert [got[i] for i, _ in mine] == pytest.approx(brute_bh([p for _, p in mine]))
    assert got[1001] == pytest.approx(0.03)
    assert special.bh([p for _, _, p in rows]) == pytest.approx(brute_bh([p for _, _, p in rows]))
    clash = ranks.benjamini_hochberg(df.withColumn("n", F.lit(5)).withColumn("rk", F.lit("x")), "p", "id").collect()
    assert all(r.n == 5 and r.rk == "x" for r in clash) and len(clash) == 402
    empty = df.limit(0)
    assert ranks.benjamini_hochberg(empty, "p", "id").count() == 0 and ranks.bonferroni(empty, "p").count() == 0


def test_ties_have_equal_results(spark):
    df = spark.createDataFrame([(i, 0.04) for i in range(50)] + [(100 + i, 0.001) for i in range(3)], "id int, p double")
    got = ranks.benjamini_hochberg(df, "p", "id").collect()
    assert len({r.q for r in got if r.id < 100}) == 1 and len({round(r.q, 12) for r in got if r.id >= 100}) == 1


def test_tails_and_sums_before(spark):
    rng = np.random.default_rng(4)
    v = [float(x) for x in rng.integers(0, 30, 500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(900, None)], "id int, v double")
    got = {r.id: r.p for r in ranks.share_at_least(df, "v").collect()}
    assert got.pop(900) is None and got == pytest.approx({i: sum(y >= x for y in v) / len(v) for i, x in enumerate(v)})
    w = spark.createDataFrame([("a", x, int(x) + 1) for x in range(40)] + [("b", 5, 2)], "g string, v int, w int")
    sums = {(r.g, r.v): r.before for r in ranks.with_sum_before(w, "v", "w", ["g"]).collect()}
    assert sums == {("b", 5): 0} | {("a", x): sum(range(1, x + 1)) for x in range(40)}


def test_digest_in_order(spark):
    import hashlib

    rows = [f"{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(x,) for x in reversed(rows)] + [(None,)], "h string").repartition(7)
    assert ranks.ordered_digest(df, "h").first().digest == hashlib.sha256("|".join(rows).encode()).hexdigest()[:12]
    assert ranks.ordered_digest(df.limit(0), "h").first().digest is None


# ---- statistics ----


def test_bootstrap_equals_the_published_draws():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0.0, 1.0, size=30), rng.normal(0.3, 1.0, size=40)
    assert cp.bootstrap_ci(a, b, 200, seed=42) == pytest.approx((0.2601315351229742, 1.1295517416236465), rel=1e-12)
    assert cp.bootstrap_ci(a[:0], b) == (0.0, 0.0)


@pytest.mark.parametrize("m,n", [(3, 4), (2, 9), (5, 5), (1, 6)])
def test_exact_rank_sum(m, n):
    ways = {}
    for c in itertools.combinations(range(m + n), m):
        u = sum(c) - m * (m - 1) // 2
        ways[u] = ways.get(u, 0) + 1
    for u in ways:
        want = min(1.0, 2 * sum(w for k, w in ways.items() if k >= max(u, m * n - u)) / sum(ways.values()))
        assert special.u_exact_sf2(u, m, n) == pytest.approx(want) == pytest.approx(special.u_exact_sf2(m * n - u, n, m))


def test_p_values_against_published_tables(spark):
    assert special.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_sf(9.487729037, 4) == pytest.approx(0.05, abs=1e-8)
    assert special.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    df = spark.createDataFrame([(2.228138852, 10.0), (None, 10.0)], "t double, df double")
    assert [r.p for r in df.select(an.t_p("t", "df").alias("p")).collect()] == [pytest.approx(0.05, abs=1e-8), None]
    clamped = [r.p for r in spark.createDataFrame([(0.3,), (-1.0,), (2.0,), (None,), (float("nan"),), (float("inf"),)], "p double").select(an.clamp_p(F.col("p")).alias("p")).collect()]
    assert clamped == [0.3, 0.0, 1.0, 1.0, 1.0, 1.0]


# ---- detection ----


def brute_segments(x: np.ndarray, penalty: float, cost, least: int = 5) -> float:
    n = len(x)
    ends = [e for e in range(5, n, 5)] + [n]
    best = {0: -penalty}
    for e in ends:
        ways = [best[a] + cost(a, e) + penalty for a in best if e - a >= least]
        if ways:
            best[e] = min(ways)
    return best[n]


@pytest.mark.parametrize("cost", ["l2", "l1", "rbf"])
def test_segmentation_is_optimal(cost):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 1, 20) for m in (0, 3, -2)])
    square = cp._kernel_sums(x)

    def own(a: int, b: int) -> float:
        part = x[a:b]
        if cost == "l2":
            return float(((part - part.mean()) ** 2).sum())
        if cost == "l1":
            return float(np.abs(part - np.median(part)).sum())
        return (b - a) - (square[b, b] - square[a, b] - square[b, a] + square[a, a]) / (b - a)

    penalty = 1.5
    cuts = [0, *cp.pelt(x, penalty, cost=cost), len(x)]
    got = sum(own(a, b) for a, b in zip(cuts, cuts[1:])) + penalty * (len(cuts) - 2)
    assert got == pytest.approx(brute_segments(x, penalty, own)) and len(cuts) >= 4
    with pytest.raises(ValueError):
        cp._kernel_sums(np.zeros(cp.MOST_KERNEL + 1))


def test_null_series_as_published(spark):
    """200 series of 500 normal values, penalty 5, squared costs: mean 1.71, deviation 1.68 in the published run."""
    breaks = [r.breaks for r in cp.null_breaks(spark.range(200).withColumnRenamed("id", "entity").repartition(5)).collect()]
    assert np.mean(breaks) == pytest.approx(1.71, abs=0.4) and np.std(breaks) == pytest.approx(1.68, abs=0.5)
    again = [r.breaks for r in cp.null_breaks(spark.range(200).withColumnRenamed("id", "entity").coalesce(1)).collect()]
    assert sorted(again) == sorted(breaks)


def test_read_outs_and_predictives():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, 120), rng.normal(6, 1, 120)]
    assert any(abs(t - 120) <= 6 for t, _ in cp.bocpd(x, predictive="normal"))
    pinned = cp.bocpd(x, hazard=0.01, predictive="normal", read_out="legacy", threshold=0.0)
    assert len(pinned) == len(x) - 1 and all(p == pytest.approx(0.01, rel=1e-6) for _, p in pinned)  # a constant hazard pins it
    assert cp.bocpd(x, read_out="legacy") == []
    assert cp.merged([(3, 0.2), (5, 0.9), (7, 0.3), (20, 0.1)], 2) == [(5, 0.9), (20, 0.1)]


def test_online_equals_batch_beyond_any_memory():
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(m, 1, 450) for m in (0, 5, -3, 2, 9, 0)])
    assert len(x) == 2700
    row, got = None, []
    for part in np.array_split(x, 9):
        entity = Online(1 / 250, row)
        got += [a for v in part for a in entity.take(float(v))]
        row = entity.row()
    want = cp.bocpd(x)
    assert [t for t, _ in got] == [t for t, _ in want] and [p for _, p in got] == pytest.approx([p for _, p in want])
    assert len(want) >= 5


def test_streamed_alarms_are_exactly_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=60), rng.normal(7, 1, 60)]
    for k in range(3):
        pd.DataFrame({"entity": 1, "i": range(40 * k, 40 * k + 40), "value": x[40 * k : 40 * k + 40]}).to_parquet(tmp_path / f"in{k}.parquet")
    stream = spark.readStream.schema("entity bigint, i bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = online_breaks(stream).writeStream.format("memory").queryName("exact_alarms").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["at"] for r in spark.sql("select * from exact_alarms").collect()) == [at for at, _ in cp.bocpd(x)]


# ---- series analysis ----


def long_rows(spark, rng, shift: float):
    rows = [(e, k, e * 1000 + k, "a" if k % 2 else "b", float(rng.normal() + (shift if k >= 60 else 0) + (4 if k % 2 else 0))) for e in (1, 2) for k in range(120)]
    df = spark.createDataFrame(rows, "e bigint, d int, tie bigint, s string, v double").withColumn("ts", F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, d)"))
    return an.long_form(df, "e", "ts", ["tie"], {"v": "v", "w": "-v", "flat": "1"}, "s")


def test_changes_tests_and_gate(spark):
    long = long_rows(spark, np.random.default_rng(5), 5.0)
    found = an.changes(an.residualised(long), ("pelt",), penalty=20.0)
    rows = found.collect()
    assert {r.feature for r in rows} == {"v", "w"} and all(any(abs(r.at - 60) <= 5 for r in rows if r.entity == e and r.feature == "v") for e in (1, 2))
    tests = an.tests_at(long, found).withColumn("id", F.concat_ws("/", "entity", "feature", "at", "test"))
    gated = an.gated(tests, "id").collect()
    assert any(r.significant for r in gated) and all(r.q is None and not r.significant for r in gated if r.skipped)
    assert all(r.q >= r.p for r in gated if r.q is not None)


def test_contrast_and_profile(spark):
    long = long_rows(spark, np.random.default_rng(6), 0.0)
    families = {"v": "one", "w": "two", "flat": "three"}
    got = {(r.entity, r.family, r.features) for r in an.contrast(long, families).collect()}
    assert got == {(e, f, x) for e in (1, 2) for f, x in (("one", "v"), ("two", "w"))}
    assert an.contrast(long.filter("section = 'a'"), families).count() == 0
    p = an.profile(long, families, least_families=2).first()
    assert p.sections == 2 and p.families == "one,two" and p.verdict == "PASS"
    assert an.profile(long.filter("section = 'a'"), families).first().verdict == "DEGENERATE"
    h = {r.feature: r for r in an.kruskal(long, an.retained_sections(long)).collect()}
    assert h["flat"].h is None and h["flat"].eta == 0.0 and h["v"].p < 1e-10


def test_labels_and_calibration(spark):
    points = spark.createDataFrame([(1, d, f"f{k % 4}") for k, d in enumerate(pd.date_range("2020-01-01", periods=40, freq="9D").date)], "entity bigint, day date, feature string")
    windows = points.select("entity", F.col("day").alias("start"), F.date_add("day", 30).alias("stop"))
    r = an.label_permutation(points, windows, 4, n=200).first()
    assert r.observed == 1.0 and 0 < r.p <= 1 and r == an.label_permutation(points.repartition(3), windows, 4, n=200).first()
    rng = np.random.default_rng(8)
    series = spark.createDataFrame([(e, i, float(rng.normal())) for e in range(4) for i in range(200)], "entity bigint, i int, value double")
    m = an.metrics(an.calibration(series, shift=5.0)).first()
    assert m.tp == 20 and m.sensitivity == 1.0 and m.tp + m.fn + m.fp + m.tn == 40
    nothing = an.metrics(an.calibration(series, shift=5.0).limit(0)).first()
    assert nothing.sensitivity == nothing.f1 == 0.0 and nothing.median_error is None


def test_dispersion_takes_both_branches(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(60, 4))
    rows = [(i, 1, v.tolist()) for i, v in enumerate(vectors)] + [(5000, 2, [1.0, 0.0, 0.0, 0.0]), (5001, 3, None)]
    got = {(r.period, r.label, r.month): r.dispersion for r in drift.dispersion(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")).collect()}
    cos = lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert got["all", 1, None] == pytest.approx(np.mean([cos(v, vectors.mean(0)) for v in vectors]), abs=1e-6)
    assert got["month", 1, 1] == pytest.approx(np.mean([cos(a, b) for a, b in itertools.combinations(vectors[50:], 2)]), abs=1e-6)
    assert got["month", 2, 100] == 0.0 and len(got) == 5


# ---- prints ----


def test_prints_at_any_distance(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2, (6, 128))
    rows = []
    for k in range(60):
        bits = base[k % 6].copy()
        bits[rng.choice(128, int(rng.integers(0, 8)), replace=False)] ^= 1
        rows.append((k, [int("".join(map(str, bits[32 * j : 32 * j + 32])), 2) for j in range(4)]))
    df = spark.createDataFrame(rows, "id bigint, bands array<bigint>")
    first = {}
    for k, b in rows:
        first.setdefault(tuple(b), k)
    for most in (0, 3, 7, 12):
        got = {(r.a, r.b): r.distance for r in fp.near_pairs(df, "id", most).collect()}
        want = {}
        for (p, i), (q, j) in itertools.combinations(sorted(first.items(), key=lambda z: z[1]), 2):
            d = sum((x ^ y).bit_count() for x, y in zip(p, q))
            if d <= most:
                want[i, j] = d
        assert got == want
    assert {(r.id, r["class"]) for r in fp.print_classes(df, "id").collect()} == {(k, first[tuple(b)]) for k, b in rows}
    with pytest.raises(ValueError):
        fp.near_pairs(df, "id", 32)
    back = df.select("id", "bands", fp.from_hex(fp.to_hex(F.col("bands"))).alias("again")).collect()
    assert all(r.bands == r.again for r in back)
    assert spark.createDataFrame([("xyz",), (None,), ("0" * 31,)], "h string").select(fp.from_hex(F.col("h")).alias("b")).filter("b is not null").count() == 0


# ---- artifacts and documents ----


def test_artifacts_are_whole_or_absent(tmp_path):
    path = art.write_artifact(tmp_path / "a" / "x.json", {"b": 1, "a": "é"})
    assert list(json.loads(path.read_text())) == ["a", "b"]
    with pytest.raises(TypeError):
        art.write_artifact(path, {"b": object()})
    assert json.loads(path.read_text())["b"] == 1 and [p.name for p in path.parent.iterdir()] == ["x.json"]


def test_configuration_locks(tmp_path):
    t = {"alpha": 0.05, "window": 90}
    assert art.config_hash(t) == art.config_hash(dict(reversed(t.items()))) != art.config_hash(t | {"alpha": 0.1})
    assert art.config_hash(t, 12, frozenset(["alpha"])) == art.config_hash({"window": 90}, 12)
    path = art.lock(tmp_path / "lock.json", t)
    assert art.verify_lock(path, t) == [] and art.verify_lock(path, {"alpha": 0.05, "days": 3}) == ["days", "window"]
    path.write_text(path.read_text().replace("90", "60"))
    assert art.verify_lock(path, t) == ["lock was edited", "window"] and art.verify_lock(tmp_path / "none", t) == ["no lock"]


def test_versioned_features(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, x string")
    path = art.write_versioned(df, f"{tmp_path}/new")
    assert [r.id for r in art.read_versioned(spark, path, ["id"]).collect()] == [1, 2]
    old = art.write_versioned(df, f"{tmp_path}/old", 1)
    with pytest.raises(Exception, match="schema of version 1"):
        art.read_versioned(spark, old, ["id"]).collect()
    with pytest.raises(ValueError):
        art.read_versioned(spark, path, ["missing"])
    assert art.read_entity(spark, path, "x", "zzz").count() == 0
    with pytest.raises(ValueError):
        art.checked_name("x; drop table y")


def test_vectors_through_their_gates(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, [0.0, 0.25])], "id int, v array<float>")
    packed = art.pack(df, "v").drop("v")
    assert {r.id: r.vector for r in art.unpack(packed, "packed", 2).collect()} == {1: [1.5, -2.0], 2: [0.0, 0.25]}
    assert art.unpack(packed, "packed", 3).count() == 0
    with pytest.raises(Exception, match="vector of bytes"):
        art.unpack(packed, "packed", 3, strict=True).collect()
    with pytest.raises(Exception, match="another dimension"):
        art.load_vectors([df.withColumnRenamed("v", "vector")], "id", 3, strict=True).collect()
    bad = spark.createDataFrame([('{"a": 1, "b": 2.5}',), ("[1]",), ("x",), (None,)], "j string")
    assert [r.m for r in bad.select(art.decoded_numbers(F.col("j")).alias("m")).collect()] == [{"a": 1.0, "b": 2.5}, None, None, None]
    with pytest.raises(Exception, match="not a JSON object"):
        bad.select(art.decoded_numbers(F.col("j"), True)).collect()


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div class='entry-content'><p>One</p><nav>menu</nav><div class='Related-Posts x'>no</div><p>Two <b>2</b></p></div><article>other</article>", "One\nTwo\n2"),
        ("<article><p>A &amp; B</p><script>x()</script></article><div class='post-content'>no</div>", "A & B"),
        ("<div class='post-content'>C<br>D<div><aside>no</aside>E</div>", "C\nD\nE"),
        ("<p>nothing</p>", ""), ("", ""), (None, ""),
    ],
)
def test_bodies_by_precedence(page, want):
    assert docs.body_of(page).replace("\n", " ").split() == want.replace("\n", " ").split()


def test_answers_in_all_their_shapes():
    inner = {"headline": "H", "text": "T {x}"}
    for raw in (json.dumps(inner), f"Sure! {{not json}} {json.dumps(inner)} bye", json.dumps({"parameters": inner}), json.dumps({"arguments": inner}), json.dumps({"name": "f", "arguments": json.dumps(inner)}), f"```json\n{json.dumps(inner)}\n```", 'see {"a": 1} then ' + json.dumps({"article": inner})):
        assert docs.parse_generated(raw) == ("H", "T {x}"), raw
    assert docs.parse_generated("# Head\n\nBody text") == ("Head", "Body text")
    assert docs.parse_generated(None) == ("", "") and docs.parse_generated("{" * 200)[1] == "{" * 200


def test_written_tables_are_released_and_broadcasts_checked(spark):
    df = runtime.written(spark.range(10), "ten")
    path = runtime._tables[-1][1].removeprefix("file://")
    from pathlib import Path

    assert Path(path).exists() and runtime.rows_of(df) == 10
    held, runtime._tables[:] = runtime._tables[:-1], runtime._tables[-1:]
    runtime.release()
    runtime._tables[:] = held
    assert not Path(path).exists()
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(runtime.broadcast_if_small(spark.range(5), 5)).lower()
    assert "broadcast" not in plan(runtime.broadcast_if_small(spark.range(5), 10_000_000)).lower()


def test_embeddings_of_texts(spark):
    df = spark.createDataFrame([(1, "One two two"), (2, None), (3, "1 2 3"), (4, "x " * 5000)], "id int, t string")
    got = {r.id: r.embedding for r in em.hashed(df, "t", 8).collect()}
    assert got[2] is None and got[3] == [0.0] * 8 and all(sum(x * x for x in got[k]) == pytest.approx(1) for k in (1, 4))
    assert em.hashed(df.limit(0), "t", 8).count() == 0
    with pytest.raises(Exception, match="the model gave"):
        em.embed(df, "t", lambda: em.hashing_model(4), 8).collect()


def test_promotion_is_whole(spark, tmp_path):
    for k in (1, 2):
        spark.range(k).write.parquet(f"file://{tmp_path}/made{k}")
        art.promote(spark, f"file://{tmp_path}/made{k}", f"file://{tmp_path}/final")
        assert spark.read.parquet(f"file://{tmp_path}/final").count() == k
    (tmp_path / "half").mkdir()
    with pytest.raises(ValueError):
        art.promote(spark, f"file://{tmp_path}/half", f"file://{tmp_path}/final")
    assert spark.read.parquet(f"file://{tmp_path}/final").count() == 2


def test_limited_stream_and_replayed_rows(spark, tmp_path):
    for k in range(3):
        pd.DataFrame({"id": [f"a{k}", "a0"], "at": pd.to_datetime(["2024-01-01", "2024-01-01"])}).to_parquet(tmp_path / f"{k}.parquet", coerce_timestamps="us")
    stream = streams.limited_stream(spark, str(tmp_path), "id string, at timestamp_ntz", 1)
    q = streams.first_seen(stream, "id", "at").writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.sql("select id from seen_once").collect()) == ["a0", "a1", "a2"]
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3  # one file at a time
