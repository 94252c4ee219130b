import functools
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.operators import evidence as ev
from siteloom.operators import graph
from siteloom.operators import inference as inf
from siteloom.operators import matching as ma
from siteloom.operators import ranks
from siteloom.operators import scoring as sc
from siteloom.operators import sites as st

PAIRS = "pair_id string, pos_accession string, best_loss_positive_position double, analysis_ready boolean, cluster_id string, neg_accession string, source string"


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("a", "P1", 10.0, True, "c2", "n", "s"), ("b", "P1", 10.0, True, "c10", "n", "s"), ("c", "P1", 10.0, True, None, "n", "s"), ("d", "P1", 55.0, True, "c1", "n", "s"), ("e", "P2", 7.0, False, "c1", "n", "s"), ("f", "P3", None, True, "c1", "n", "s"), ("g", "P4", float("nan"), True, "c1", "n", "s")]
    return spark.createDataFrame(rows, PAIRS)


def test_universe_and_subsets(spark, pairs):
    homology = spark.createDataFrame([("a", "weak", 1), ("a", "strict", 2), ("b", "strict", 3), ("d", "plausible", 4)], "pair_id string, homology_qc_bucket string, line_no int")
    assert sorted(map(tuple, st.candidate_sites(pairs).collect())) == [("P1", 10), ("P1", 55)]
    assert st.missing_positions(st.ready(pairs)).first().n_missing == 2
    links = st.associations(pairs, homology, ["line_no"])
    assert sorted(map(tuple, st.subsets(links).collect())) == [("P1", 10, True, True, 3), ("P1", 55, False, True, 1)]
    assert {r.position: r.ortholog_clusters for r in st.clusters(links).collect()} == {10: "c10;c2", 55: "c1"}
    with pytest.raises(KeyError):
        st.ready(pairs.drop("analysis_ready"))


def test_keep_first_and_shards(spark):
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("j", 5, "only")], "k string, n int, v string")
    assert {r.k: r.v for r in st.keep_first(rows, ["k"], ["n"]).collect()} == {"k": "early", "j": "only"}
    parts = [{r.k for r in st.shard(rows, ["k"], f"{i}/2").collect()} for i in range(2)]
    assert parts == [{"j"}, {"k"}]
    with pytest.raises(ValueError):
        st.shard(rows, ["k"], "2/2")


def test_annotation_layer_and_combination(spark):
    sites = spark.createDataFrame([("P1", 10), ("P1", 11), ("P2", 3), ("P3", 1), ("P4", 5)], "accession string, position int")
    features = spark.createDataFrame([("P1", 10, "N-linked", ["ECO:0000269"], "", "ok"), ("P2", 3, "N-linked", ["ECO:0000305"], "", "ok"), ("P4", 5, "O-linked", ["ECO:0000269"], "", "ok")], "accession string, position int, glyco_type string, evidence_codes array<string>, raw_note string, parse_status string")
    absent = spark.createDataFrame([("P3",)], "accession string")
    layer = ev.annotation_layer(sites, features, absent, ev.Policy())
    got = {(r.accession, r.position): (r.uniprot_tier, r.uniprot_qualifies, r.exclusion_reason) for r in layer.collect()}
    assert got["P1", 10] == ("manual_experimental", True, "") and got["P2", 3] == ("manual_curator_inference", False, "curator_inference_only")
    assert got["P3", 1] == ("", False, "accession_absent_from_snapshot") and got["P1", 11] == got["P4", 5] == ("exact_feature_absent", False, "exact_feature_absent")
    structure = spark.createDataFrame([("P2", 3, "structure_residue_resolved", True), ("P1", 11, "structure_linked_glycan", True)], "accession string, position int, structure_tier string, structure_internal_control boolean")
    combined = {(r.accession, r.position): r for r in ev.combine(layer, [structure], ev.Policy()).collect()}
    assert combined["P1", 11].occupancy_status == "occupied_supported" and combined["P1", 11].exclusion_reason == "" and combined["P1", 11].support_sources == "structure"
    assert combined["P2", 3].occupancy_status == "observed_unmodified" and combined["P3", 1].occupancy_status == "unknown" and combined["P1", 10].support_count == 1


def test_glycan_layers(spark):
    entry = "accession string, type string, start_pos int, end_pos int, categories array<string>, evidence array<struct<database:string,id:string>>, glytoucan_ac string"
    rows = spark.createDataFrame([("P", "N-linked", 5, 5, ["predicted"], [("UniProtKB", "x")], ""), ("P", "N-Linked", 5, 5, ["reported"], [("PubMed", "9"), ("PubMed", "10")], "G1"), ("P", "N-linked", 5, 6, ["reported_with_glycan"], [], "G2"), ("P", "O-linked", 8, 8, ["reported"], [], "")], entry)
    (r,) = ev.glycan_sites(rows).collect()
    assert (r.position, r.glygen_tier, r.glygen_categories, r.glygen_pubmed_ids, r.glygen_glytoucan_ids) == (5, "glygen_reported_independent", "predicted|reported", "10|9", "G1")
    comp = spark.createDataFrame([("P", "H5N2", [("Asn-80", True)]), ("P", "", [("Asn-80", None), ("Asn-120", True)]), ("P", "X", [("Ser-1", True)])], "accession string, composition_string string, sites array<struct<site:string,reviewed:boolean>>")
    assert sorted((r.position, r.glyconnect_glycan_count, r.glyconnect_compositions) for r in ev.composition_sites(comp).collect()) == [(80, 2, "H5N2"), (120, 1, "")]


def side(spark, seed, n, shift=0.0):
    r = random.Random(seed)
    return spark.createDataFrame([(f"{'ab'[seed % 2]}{i}", 1, r.gauss(shift, 1), r.gauss(shift, 1), r.choice("xy")) for i in range(n)], "accession string, position int, f double, g double, kind string")


def test_caliper_edges_equal_all_pairs(spark):
    a, b = side(spark, 0, 40), side(spark, 1, 60)
    got = {(r.case_accession, r.control_accession): r.distance for r in ma.caliper_edges(a, b, ["f", "g"], 0.4, ("kind",)).collect()}
    x, y = a.toPandas(), b.toPandas()
    scale = {c: np.std(np.concatenate((x[c], y[c])), ddof=1) for c in "fg"}
    want = {}
    for p, q in itertools.product(x.itertuples(), y.itertuples()):
        d = math.dist((p.f / scale["f"], p.g / scale["g"]), (q.f / scale["f"], q.g / scale["g"]))
        if p.kind == q.kind and d <= 0.4:
            want[p.accession, q.accession] = d
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want) and len(want) > 20


def test_matching_equals_brute_force():
    r = random.Random(5)
    for _ in range(60):
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        costs = {(i, j): round(r.random(), 3) for i in range(n) for j in range(m) if r.random() < 0.5}
        got = ma.min_cost_matching(costs, n, m)
        best = (0, 0.0)
        for pick in itertools.product(*([None, *range(m)] for _ in range(n))):
            used = [j for j in pick if j is not None]
            if len(set(used)) == len(used) and all((i, j) in costs for i, j in enumerate(pick) if j is not None):
                best = min(best, (-len(used), sum(costs[i, j] for i, j in enumerate(pick) if j is not None)))
        assert len(got) == -best[0] and math.isclose(sum(costs[e] for e in got.items()), best[1], abs_tol=1e-9)


def test_greedy_and_optimal(spark):
    edges = ma.caliper_edges(side(spark, 0, 30), side(spark, 1, 30), ["f", "g"], 0.5, ("kind",)).cache()
    greedy, optimal = ma.greedy_pairs(edges, 1, 3).collect(), ma.optimal_pairs(edges).collect()
    for rows in (greedy, optimal):
        assert len({r.case_accession for r in rows}) == len({r.control_accession for r in rows}) == len(rows)
    assert len(optimal) >= len(greedy) > 3
    none = ma.optimal_pairs(edges.limit(0))
    assert none.collect() == [] and none.columns == ["case_accession", "case_position", "control_accession", "control_position", "distance", "match_rank"]


def test_components(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("z", "y"), ("q", "q")], "a string, b string")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert set(got.values()) == {"n00", "y", "q"} and got["n30"] == "n00" and got["z"] == "y"


def test_contrasts_and_units(spark):
    pairs = spark.createDataFrame([("A", 1, "X", 1), ("A", 1, "Y", 1), ("B", 1, "Y", 1), ("C", 1, "Z", 1), ("D", 1, "X", 1)], "case_accession string, case_position int, control_accession string, control_position int")
    scores = spark.createDataFrame([("A", 1, 2.0), ("B", 1, 1.0), ("C", 1, 5.0), ("D", 1, float("nan")), ("X", 1, 1.0), ("Y", 1, 0.0), ("Z", 1, None)], "accession string, position int, score double")
    rows = inf.resample_units(inf.contrasts(pairs, scores, spark.createDataFrame([("A", 1, "k9;k1")], "accession string, position int, ortholog_clusters string")))
    got = {r.case_accession: r for r in rows.collect()}
    assert set(got) == {"A", "B"} and got["A"].contrast == 1.5 and got["A"].ortholog_cluster == "k9" and got["B"].ortholog_cluster == "solo:B"
    assert got["A"].resample_unit == got["B"].resample_unit == "cluster:k9"


def test_rank_tests():
    assert math.isclose(inf.signed_rank_p(np.array([1.0, 2, 3, 4, 5])), 2 / 32)
    assert inf.signed_rank_p(np.zeros(4)) == 1.0 and 0.5 < inf.signed_rank_p(np.array([1.0, -1, 2, -2, 3, -3])) <= 1.0
    assert math.isclose(inf.sign_test_p(9, 10), 22 / 1024) and inf.sign_test_p(5, 10) == 1.0


def test_adjusted(spark):
    rows = inf.adjusted(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")).collect()
    got = {r.test: (round(r.p_holm, 6), round(r.p_bh, 6)) for r in rows}
    assert got == {"a": (0.03, 0.03), "b": (0.06, 0.04), "c": (0.06, 0.04)}


def test_scoring_failures_are_rows(spark):
    manifest = spark.createDataFrame([("P", 1, "s", "A", 0, 1, 2), ("P", 4, "s", "A", 3, 4, 5), ("Q", 1, "gone", "A", 0, 1, 2)], "accession string, position int, structure_pdb_id string, structure_chain_id string, n_model_index int, plus1_model_index int, plus2_model_index int")
    chains = spark.createDataFrame([("s", "A", "NATNX")], "structure_pdb_id string, structure_chain_id string, sequence string")
    rows = {(r.accession, r.position): r for r in sc.score_chains(manifest, chains, "hash", n_orders=3, seed=None).collect()}
    good = rows["P", 1]
    assert good.error is None and good.n_decoding_orders == 3 and good.model == "hash" and math.isclose(sum(good.probs_n), 1) and good.p_ser_or_thr_at_plus2 > 0
    assert rows["P", 4].conditional_sequon_score is None and "incomplete_backbone" in rows["P", 4].error and "chain_not_found" in rows["Q", 1].error
    kept = sc.design_chains(manifest.where("accession = 'P' and position = 1"), chains, "hash", n_designs=12, temperature=0.0).first()
    assert kept["std"].n_full_sequon_retained == 12 and kept.pre.n_designs_scored == 8
    with pytest.raises(KeyError):
        sc.load("unknown")


def test_chains_in_packs(spark, tmp_path):
    """Packs keep within the slots, results are those of one chain at a time, a pack that fails fails nobody."""

    class Packing(sc.HashModel):
        """Writes down what it is given at once; fails as a whole if any chain has a W."""

        def __init__(self, log, **options):
            super().__init__(**options)
            self.log = log

        def probabilities_many(self, sequences, places):
            with open(self.log, "a") as f:
                f.write(" ".join(str(len(s)) for s in sequences) + "\n")
            if any("W" in s for s in sequences):
                raise RuntimeError("out of memory")
            return [self.probabilities(s, p) for s, p in zip(sequences, places)]

    assert sc.packed([5, 3, 9, 3, 20], 10) == [[1, 3], [0], [2], [4]] and sc.packed([], 10) == [] and sc.packed([0, 0, 1], 1) == [[0, 1], [2]]
    r = random.Random(1)
    letters = [("".join(r.choice("ACDNSTX") for _ in range(r.randint(4, 60)))) for _ in range(80)] + ["NASW" * 3, None, ""]
    chains = spark.createDataFrame([(f"s{k}", "A", c) for k, c in enumerate(letters)], "structure_pdb_id string, structure_chain_id string, sequence string")
    asked = [("P", k, f"s{k}", "A", i, i + 1, i + 2) for k in range(len(letters)) for i in (0, 1)] + [("P", 0, "s0", "A", None, 1, 2)]
    manifest = spark.createDataFrame(asked, "accession string, position int, structure_pdb_id string, structure_chain_id string, n_model_index int, plus1_model_index int, plus2_model_index int")
    log = str(tmp_path / "packs")
    sc.register("packing", functools.partial(Packing, log))
    try:
        key = lambda row: str(row)
        want = sorted((tuple(x) for x in sc.score_chains(manifest, chains, "hash", n_orders=2).collect()), key=key)
        for slots in (100, 7, 6000):
            open(log, "w").close()
            rows = sc.score_chains(manifest.orderBy(F.rand(slots)), chains, "packing", slots=slots, n_orders=2)
            assert sorted((tuple(x) for x in rows.collect()), key=key) == want
            packs = [[int(n) for n in line.split()] for line in open(log) if line.strip()]
            assert all(len(p) == 1 or len(p) * max(p) <= slots for p in packs) and (slots < 100 or max(map(len, packs)) > 2)
    finally:
        sc.unregister("packing")


def test_segments(spark):
    rows = spark.createDataFrame([(0, 2.0), (0, 3.0), (2, 5.0)], "index long, src double")
    got = {r["index"]: (r["sum"], r["mean"], r["mul"]) for r in sc.segment_reduce(rows, 4).collect()}
    assert got == {0: (5.0, 2.5, 6.0), 1: (0.0, 0.0, 1.0), 2: (5.0, 5.0, 5.0), 3: (0.0, 0.0, 1.0)}


def test_greedy_equals_taking_turns(spark):
    edges = ma.caliper_edges(side(spark, 0, 60), side(spark, 1, 25), ["f", "g"], 0.9, ("kind",)).cache()
    rows = edges.collect()
    for k, seed in ((1, 0), (2, 4), (5, 1)):
        turn = lambda a: hashlib.md5(f"{seed}-{a}-1".encode()).hexdigest()  # noqa: B023, E731
        taken, want = set(), {}
        for case in sorted({r.case_accession for r in rows}, key=lambda a: (turn(a), a)):
            near = sorted((r.distance, r.control_accession) for r in rows if r.case_accession == case and r.control_accession not in taken)[:k]
            taken |= {c for _, c in near}
            want |= {(case, c): i + 1 for i, (_, c) in enumerate(near)}
        assert {(r.case_accession, r.control_accession): r.match_rank for r in ma.greedy_pairs(edges, k, seed).collect()} == want
    both = ma.seed_sweep(edges, [0, 7], 1).groupBy("seed").count().collect()
    assert {r.seed: r["count"] for r in both} == {s: ma.greedy_pairs(edges, 1, s).count() for s in (0, 7)}


def _in_turn(rows, k, seed):
    turn = lambda a: hashlib.md5(f"{seed}-{a}-1".encode()).hexdigest()
    taken, want, by_case = set(), {}, {}
    for case, control, d in rows:
        by_case.setdefault(case, []).append((d, control))
    for case in sorted(by_case, key=lambda a: (turn(a), a)):
        near = [e for e in sorted(by_case[case]) if e[1] not in taken][:k]
        taken |= {c for _, c in near}
        want |= {(case, c): i + 1 for i, (_, c) in enumerate(near)}
    return want


def test_greedy_chains_and_crowds_take_few_rounds(spark, monkeypatch):
    """A chain of 1,000 cases, each of which waits for the one before it, and cases that all like the same controls."""
    calls, real = [], ma.cut
    monkeypatch.setattr(ma, "cut", lambda df: calls.append(1) or real(df))
    chain = sorted((f"c{i}" for i in range(1000)), key=lambda a: hashlib.md5(f"3-{a}-1".encode()).hexdigest())
    rows = [(c, f"t{i + j}", 0.1 * (j + 1)) for i, c in enumerate(chain) for j in (-1, 0) if i + j >= 0]
    rows = [(c, t, 0.1 if int(t[1:]) < i else 0.2) for i, c in enumerate(chain) for _, t, _ in rows[max(0, 2 * i - 1) : 2 * i + 1]]
    rows += [(f"d{i}", f"u{j}", 0.01 * j) for i in range(40) for j in range(30)]
    schema = "case_accession string, control_accession string, distance double, case_position int, control_position int"
    edges = spark.createDataFrame([(*r, 1, 1) for r in rows], schema)
    got = {(r.case_accession, r.control_accession): r.match_rank for r in ma.greedy_pairs(edges, 1, 3).collect()}
    assert got == _in_turn(rows, 1, 3) and len(got) == 1030 and len(calls) < 20
    assert [got[c, f"t{i}"] for i, c in enumerate(chain)] == [1] * 1000


def test_greedy_finishes_small_components_only(spark, monkeypatch):
    """With a low bound some components are finished in tasks and others in rounds; several seeds at once."""
    monkeypatch.setattr(ma, "PATIENCE", 1)
    r = random.Random(2)
    rows = [(f"{g}-{i}", f"{g}-{j}", round(r.random(), 1)) for g in range(6) for i in range(3 + g) for j in range(2 + g)]
    edges = spark.createDataFrame([(*x, 1, 1) for x in rows], "case_accession string, control_accession string, distance double, case_position int, control_position int")
    for small in (25,):
        monkeypatch.setattr(ma, "SMALL", small)
        got = {(x.seed, x.case_accession, x.control_accession): x.match_rank for x in ma.seed_sweep(edges, [1, 2], 2).collect()}
        assert got == {(s, *key): n for s in (1, 2) for key, n in _in_turn(rows, 2, s).items()}


def test_subtypes_of_pairs_are_checked(spark):
    pairs = spark.createDataFrame([("a", 1, "b", 1)], "case_accession string, case_position int, control_accession string, control_position int")
    one = lambda a, s: spark.createDataFrame([(a, 1, s)], "accession string, position int, subtype string")
    assert ma.checked_subtypes(pairs, one("a", "NXS"), one("b", "NXS")).count() == 1
    for other in ("NXT", None):
        with pytest.raises(ma.SubtypeMismatchError):
            ma.checked_subtypes(pairs, one("a", "NXS"), one("b", other))


def test_running_totals_over_many_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.choice("abc") + str(r.randrange(4000)), r.randrange(-5, 9)) for i in range(12_000)]
    frame = spark.createDataFrame(rows, "i int, k string, n int")
    at = sorted(rows, key=lambda x: (x[1], x[0]))
    got = {x.i: (x.place, x.total, x.least, x.r) for x in ranks.numbered(ranks.running(ranks.running(ranks.ranges(frame, ["k", "i"], "r"), ["k", "i"], F.col("n"), "total"), ["k", "i"], F.col("n"), "least", "min"), ["k", "i"], "place").collect()}
    total, least = 0, 99
    for place, (i, _, n) in enumerate(at):
        total, least = total + n, min(least, n)
        assert got[i][:3] == (place, total, least)
    assert len({g[3] for g in got.values()}) > 1


def test_draws_by_arrays_and_by_join(spark, monkeypatch):
    rows = spark.createDataFrame([(f"u{i % 13}", float(i * i % 17)) for i in range(90)], "u string, v double")
    by_array = {r.draw: r["mean"] for r in inf.bootstrap_draws(rows, "u", "v", 20).collect()}
    monkeypatch.setattr(inf, "HELD_UNITS", 3)
    by_join = {r.draw: r["mean"] for r in inf.bootstrap_draws(rows, "u", "v", 20).collect()}
    assert by_array.keys() == by_join.keys() and all(math.isclose(by_array[k], by_join[k]) for k in by_array) and len(set(by_array.values())) > 10
    assert inf.bootstrap_draws(rows.limit(0), "u", "v", 5).collect() == []


def test_one_to_one_and_missing_scores(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert st.one_to_one(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    with pytest.raises(ValueError, match="right"):
        st.one_to_one(a, a.unionAll(a).withColumnRenamed("v", "w"), ["k"])
    scores = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, score double")
    assert [tuple(r) for r in inf.with_scores(a, scores, ["k"]).collect()] == [(2, "y", 3.0)]


def crowd(spark, seed, n):
    """Points of a coarse grid, so that many are equal, many distances tie, and many keys share a point."""
    r = random.Random(seed)
    return spark.createDataFrame([(f"{seed}-{i}", 1, r.choice("ab"), r.randrange(12), round(900 + r.randrange(40) / 10, 1)) for i in range(n)], "accession string, position int, kind string, f int, g double")


def by_hand(a, b, caliper):
    """(case, control) -> distance as SQL has it: differences are scaled, not values."""
    x, y = a.collect(), b.collect()
    s, t = (float(np.std([r[c] for r in (*x, *y)], ddof=1)) for c in "fg")
    every = {(p.accession, q.accession): math.sqrt(((p.f - q.f) / s) ** 2 + ((p.g - q.g) / t) ** 2) for p in x for q in y if p.kind == q.kind}
    return {k: d for k, d in every.items() if d <= caliper}


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_controls_of_a_crowd(spark, k):
    a, b = crowd(spark, 1, 150), crowd(spark, 2, 900)
    near = by_hand(a, b, 0.5)
    want = {(p, q): i + 1 for p in {p for p, _ in near} for i, (_, q) in enumerate(sorted((round(d, 12), q) for (c, q), d in near.items() if c == p)[:k])}
    got = {(r.case_accession, r.control_accession): r.match_rank for r in ma.nearest_controls(a, b, ["f", "g"], 0.5, ("kind",), k).collect()}
    edges = {(r.case_accession, r.control_accession): r.match_rank for r in ma.nearest(ma.caliper_edges(a, b, ["f", "g"], 0.5, ("kind",)), k).collect()}
    assert got == edges and len(got) > 300 * k / 3
    ranks = lambda rows: {(c, n): round(near[c, q], 9) for (c, q), n in rows.items()}
    assert ranks(got) == ranks(want)


def test_equal_differences_are_equal_distances(spark):
    """30 and 32 are both one from 31: the tie goes to the lesser key, whatever the quotients' last digits."""
    sizes = list(range(1, 51))
    a = spark.createDataFrame([(f"p{i}", 1, s) for i, s in enumerate(sizes)], "accession string, position int, f int")
    b = spark.createDataFrame([(f"z{s:02d}" if s % 2 else f"a{s:02d}", 1, s + d) for s in sizes for d in (0,)], "accession string, position int, f int")
    edges = ma.caliper_edges(a, b, ["f"], 0.2).collect()
    own = {r.case_accession: {} for r in edges}
    for r in edges:
        own[r.case_accession].setdefault(abs(sizes[int(r.case_accession[1:])] - int(r.control_accession[1:])), set()).add(r.distance)
    assert own and all(len(d) == 1 for each in own.values() for d in each.values())


@pytest.mark.parametrize("area", [200_000, 0])
def test_greedy_controls_equal_the_rounds(spark, monkeypatch, area):
    monkeypatch.setattr(ma, "AREA", area)
    a, b = crowd(spark, 3, 120), crowd(spark, 4, 200)
    edges = ma.caliper_edges(a, b, ["f", "g"], 0.5, ("kind",))
    key = lambda rows: {(r.seed, r.case_accession, r.control_accession): (r.match_rank, r.distance) for r in rows.collect()}
    got = key(ma.greedy_controls(a, b, ["f", "g"], 0.5, ("kind",), 2, (0, 7)))
    rows = [(r.case_accession, r.control_accession, r.distance) for r in edges.collect()]
    assert {k: n for k, (n, _) in got.items()} == {(s, *p): n for s in (0, 7) for p, n in _in_turn(rows, 2, s).items()}
    assert got == key(ma.seed_sweep(edges, [0, 7], 2)) and len(got) > 200


def test_assignment_equals_augmenting_paths():
    r = random.Random(8)
    for _ in range(300):
        n, m = r.randrange(1, 9), r.randrange(1, 9)
        costs = {(i, j): r.choice((0.0, 0.1, 0.25, r.random())) for i in range(n) for j in range(m) if r.random() < 0.5}
        table = np.full((n, m), np.inf)
        for e, c in costs.items():
            table[e] = c
        got, want = ma.assigned(table), ma.min_cost_matching(costs, n, m)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == len(want)
        assert math.isclose(sum(costs[e] for e in got), sum(costs[e] for e in want.items()), abs_tol=1e-9)


@pytest.mark.parametrize("most", [25_000_000, 0])
def test_optimal_controls_equal_optimal_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(ma, "COSTS", most)
    a, b = crowd(spark, 5, 60), crowd(spark, 6, 50)
    edges = ma.caliper_edges(a, b, ["f", "g"], 0.4, ("kind",))
    want = ma.optimal_pairs(edges).join(edges.select("case_accession", "control_accession", F.col("distance").alias("d")), ["case_accession", "control_accession"]).collect()
    got = ma.optimal_controls(a, b, ["f", "g"], 0.4, ("kind",)).collect()
    assert len({r.case_accession for r in got}) == len({r.control_accession for r in got}) == len(got) == len(want) > 20
    assert math.isclose(sum(r.distance for r in got), sum(r.d for r in want), abs_tol=1e-9)
