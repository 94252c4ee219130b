import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.operators import inference as inf
from siteloom.operators import matching as ma
from siteloom.operators import order_statistics as os_
from siteloom.operators import picks


def wanted(values, probabilities):
    own = [v for v in values if v is not None and not math.isnan(v)]
    return [float(np.quantile(own, p)) for p in probabilities] if own else None


@pytest.mark.parametrize("left,grid", [(100_000, 256), (150, 16)])
def test_quantiles_of_all_classes(spark, monkeypatch, left, grid):
    """One giant class, ties of any weight, far outliers, classes of one value, null and NaN."""
    monkeypatch.setattr(os_, "LEFT", left)
    monkeypatch.setattr(os_, "GRID", grid)
    r = random.Random(8)
    values = {
        "giant": [r.gauss(0, 1) for _ in range(1500)],
        "tied": [float(r.choice((1, 1, 1, 1, 2, 3))) for _ in range(400)],
        "half": [7.0] * 300 + [r.random() for _ in range(290)] + [1e300, -1e300],
        "steep": [2.0 ** -i for i in range(200)],
        "same": [4.0] * 200, "one": [3.5], "two": [1.0, 2.0], None: [1.0, None, 5.0, float("nan")] + [float(i) for i in range(90)], "none": [None, float("nan")],
    }
    rows = spark.createDataFrame([(c, v) for c, own in values.items() for v in own], "c string, v double").repartition(4)
    probabilities = {"a": 0.0, "b": 0.025, "m": 0.5, "z": 0.975, "hi": 1.0}
    got = {x.c: [x[p] for p in probabilities] for x in os_.quantiles(rows, "v", probabilities, ("c",)).collect()}
    want = {c: wanted(own, probabilities.values()) for c, own in values.items()}
    assert got.keys() == {c for c, w in want.items() if w}
    for c, own in got.items():
        assert np.allclose(own, want[c], rtol=1e-12, atol=0), c
    (whole,) = os_.quantiles(rows.where("c = 'giant'"), F.abs("v"), {"m": 0.3}).collect()
    assert math.isclose(whole.m, float(np.quantile(np.abs(values["giant"]), 0.3)))
    assert os_.quantiles(rows.limit(0), "v", {"m": 0.5}).collect() == [(None,)] and os_.quantiles(rows.limit(0), "v", {"m": 0.5}, ("c",)).collect() == []


def test_bootstrap_of_classes(spark, monkeypatch):
    r = random.Random(2)
    rows = [(s, f"u{r.randrange(3 + 5 * s)}", float(r.randrange(50))) for s in (0, 1, 3) for _ in range(60)]
    frame = spark.createDataFrame(rows, "seed int, u string, v double")
    want = {}
    for s in (0, 1, 3):
        names = sorted({u for t, u, _ in rows if t == s})
        sums = [[v for t, u, v in rows if (t, u) == (s, n)] for n in names]
        for draw in range(15):
            picks = [sums[int(hashlib.md5(f"b-{s}-{draw}-{i}".encode()).hexdigest()[:8], 16) % len(names)] for i in range(len(names))]
            want[s, draw] = sum(map(sum, picks)) / sum(map(len, picks))
    for held in (1_000_000, 4):
        monkeypatch.setattr(inf, "HELD_UNITS", held)
        got = {(x.seed, x.draw): x["mean"] for x in inf.bootstrap_by(frame, ["seed"], "u", "v", 15).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert inf.bootstrap_by(frame.limit(0), ["seed"], "u", "v", 5).collect() == []


def test_sweep_equals_seed_by_seed(spark):
    """Each seed's contrasts, units and interval are those that it would have alone; jobs don't grow with the seeds."""
    r = random.Random(6)
    edges = spark.createDataFrame([(f"a{i}", 1, f"b{j}", 1, r.random()) for i in range(40) for j in range(30) if r.random() < 0.2], "case_accession string, case_position int, control_accession string, control_position int, distance double")
    scores = spark.createDataFrame([(f"{s}{i}", 1, r.gauss(0.3 * (s == "a"), 1)) for s in "ab" for i in range(40) if i % 9], "accession string, position int, score double")
    clusters = spark.createDataFrame([(f"a{i}", 1, f"c{i % 7};x") for i in range(0, 40, 2)], "accession string, position int, ortholog_clusters string")
    tracker = spark.sparkContext.statusTracker()

    def swept(seeds):
        spark.sparkContext.setJobGroup(f"sweep-{len(seeds)}", "")
        got = {x.seed: x for x in inf.sweep(ma.seed_sweep(edges, seeds, 2), scores, clusters, 30).collect()}
        jobs = len(tracker.getJobIdsForGroup(f"sweep-{len(seeds)}"))
        spark.sparkContext.setJobGroup(None, "")
        return got, jobs

    few, before = swept([0, 1])
    many, jobs = swept(list(range(12)))
    assert len(many) == 12 and jobs < 2 * before
    assert all(math.isclose(few[s][c], many[s][c], abs_tol=1e-12) for s in (0, 1) for c in ("n_pairs", "mean", "ci_low", "ci_high"))
    for seed in (0, 5):
        alone = inf.resample_units(inf.contrasts(ma.greedy_pairs(edges, 2, seed), scores, clusters))
        values = [x.contrast for x in alone.collect()]
        assert many[seed].n_pairs == len(values) and math.isclose(many[seed]["mean"], sum(values) / len(values))
        draws = alone.withColumn("seed", F.lit(seed))
        one = inf.interval(inf.bootstrap_by(draws, ["seed"], "resample_unit", "contrast", 30, "sweep"), by=("seed",)).first()
        assert math.isclose(one.ci_low, many[seed].ci_low) and math.isclose(one.ci_high, many[seed].ci_high)


@pytest.mark.parametrize("key", ["", "b-7", "sweep-12", "sweep-199", "x" * 44, "x" * 48, "x" * 70])
def test_picks_are_md5(monkeypatch, key):
    """Every draw and slot once, over keys that end anywhere in a word, numbers of any length, and more than a block of md5."""
    monkeypatch.setattr(picks, "BLOCK", 300)
    seen = {}
    for draw, slot, found in picks.digests(key.encode(), (7, 113), (0, 121)):
        seen |= {(draw + i, slot + j): int(x) for (i, j), x in np.ndenumerate(found)}
    assert seen == {(d, s): int(hashlib.md5(f"{key}-{d}-{s}".encode()).hexdigest()[:8], 16) for d in range(7, 113) for s in range(121)}
    sums, sizes = np.arange(121.0) ** 2, np.arange(121) % 3 + 1
    want = [sum(sums[seen[d, s] % 121] for s in range(121)) / sum(sizes[seen[d, s] % 121] for s in range(121)) for d in range(7, 113)]
    assert np.allclose(picks.means(key.encode(), (7, 113), sums, sizes), want)


def test_sweep_has_verdicts(spark):
    """Each seed's interval is judged by a margin in standard deviations of all scores."""
    pairs = spark.createDataFrame([(seed, f"a{i}", 1, f"b{i}", 1) for seed in range(3) for i in range(12)], "seed int, case_accession string, case_position int, control_accession string, control_position int")
    near = {f"{s}{i}": i / 10 for s in "ab" for i in range(12)}
    for shift, spread, margin, want in ((0.0, 0.0, 0.2, "equivalent"), (9.0, 0.1, 0.2, "beyond_margin"), (0.5, 0.4, 1.0, "directional"), (0.0, 3.0, 0.2, "inconclusive")):
        values = [(n, 1, v + (n[0] == "a") * (shift + spread * (1 if int(n[1:]) % 2 else -1))) for n, v in near.items()]
        got = inf.sweep(pairs, spark.createDataFrame(values, "accession string, position int, score double"), None, 60, margin_sd=margin).collect()
        sd = margin * float(np.std([v for *_, v in values], ddof=1))
        judged = ["equivalent" if x.ci_low >= -sd and x.ci_high <= sd else "beyond_margin" if x.ci_low > sd or x.ci_high < -sd else "directional" if x.ci_low > 0 or x.ci_high < 0 else "inconclusive" for x in got]
        assert len(got) == 3 and [x.verdict for x in got] == judged and want in judged


def test_greedy_sweep_equals_sweep_of_pairs(spark, monkeypatch):
    """Contrasts made where pairs are found, whatever is kept of the points; names only where units can be shared."""
    r = random.Random(9)
    side = lambda s, n: spark.createDataFrame([(f"{s}{i}", 1, "xy"[i % 2], float(r.randrange(12)), float(r.randrange(9))) for i in range(n)], "accession string, position int, kind string, f double, g double")
    a, b = side("a", 90), side("b", 70)
    scores = spark.createDataFrame([(f"{s}{i}", 1, float("nan") if i % 11 == 3 else r.gauss(0.4 * (s == "a"), 1)) for s in "ab" for i in range(90) if i % 7], "accession string, position int, score double")
    clusters = spark.createDataFrame([(f"a{i}", 1, f"c{i % 5}") for i in range(0, 90, 3)], "accession string, position int, ortholog_clusters string")
    how, seeds = (["f", "g"], 0.5, ("kind",), 2), tuple(range(5))
    named = []
    sweep = inf.sweep
    monkeypatch.setattr(inf, "sweep", lambda *x: named.append(1) or sweep(*x))

    def check(clusters):
        got = {x.seed: x for x in inf.greedy_sweep(a, b, scores, clusters, *how, seeds, 40).collect()}
        names = len(named)
        for x in sweep(ma.greedy_controls(a, b, *how, seeds), scores, clusters, 40).collect():
            y = got.pop(x.seed)
            assert x.n_pairs > 20 and all(math.isclose(x[c], y[c], abs_tol=1e-12) for c in ("n_pairs", "mean", "ci_low", "ci_high")) and x.verdict == y.verdict
        assert not got
        return names

    assert check(None) == 0
    monkeypatch.setattr(ma, "KEPT", 25)
    assert check(None) == 0
    monkeypatch.setattr(ma, "AREA", 30)
    assert check(None) == 0
    assert check(clusters) == 1


def test_signed_rank_of_classes(spark):
    r = random.Random(4)
    values = {"few": [1.0, 2.0, 3.0, 4.0, 5.0], "exact": [r.gauss(0.3, 1) for _ in range(30)], "fifty": [r.gauss(0.2, 1) for _ in range(50)], "many": [r.gauss(0.1, 1) for _ in range(51)], "ties": [float(r.choice((-2, -1, 1, 2, 3))) for _ in range(20)], "zero": [0.0, *(r.gauss(0, 1) for _ in range(12))], "zeros": [0.0, 0.0], "one": [-3.0]}
    frame = spark.createDataFrame([(c, v) for c, own in values.items() for v in (*own, None, float("nan"))], "c string, v double")
    got = {x.c: x for x in inf.signed_rank_tests(frame, "c", "v").collect()}
    assert got.keys() == values.keys()
    for c, own in values.items():
        assert math.isclose(got[c].p, inf.signed_rank_p(np.array(own)), rel_tol=1e-9), c
        assert got[c].n == sum(v != 0 for v in own)
    assert math.isclose(got["few"].p, 2 / 32) and got["zeros"].p == 1.0 and got["zeros"].z is None


def test_brackets_go_to_the_values(spark):
    """A table of values is small by its file; it must never be sent to all tasks."""
    from siteloom.operators import order_statistics as os_

    x = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    brackets = spark.range(10_000_000).selectExpr("cast(id as string) k", "id place", "cast(null as double) lo", "cast(null as double) hi")
    plan = os_._inside(x, brackets, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
