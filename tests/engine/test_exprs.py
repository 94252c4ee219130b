import math
import random
import re

from pyspark.sql import functions as F

from siteloom.functions import exprs as x


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first().o


def test_feature_parsing(spark):
    text = 'CARBOHYD 10; /note="N-linked (GlcNAc...) asparagine"; /evidence="ECO:0000269|PubMed:1, ECO:0000255"; CARBOHYD 10..12; /note="O-linked (GalNAc...) serine"; CARBOHYD ; x; CARBOHYD 7; /note="N-linked (Glc) (glycation) lysine"'
    rows = x.parse_features(spark.createDataFrame([("P1", text), ("P2", None)], "accession string, Glycosylation string")).collect()
    assert [(r.position, r.glyco_type, r.parse_status) for r in rows] == [(10, "N-linked", "ok"), (None, "O-linked", "uncertain_or_range_position"), (None, "unknown", "uncertain_or_range_position"), (7, "glycation", "ok")]
    assert rows[0].evidence_codes == ["ECO:0000255", "ECO:0000269"]


def test_tiers(spark):
    codes = lambda c: one(spark, x.annotation_tier, c, "array<string>")
    assert codes(["ECO:0000255", "ECO:0007744"]) == "manual_combinatorial"
    assert codes([]) == codes(["ECO:1"]) == "annotation_without_qualifying_evidence"
    tier = lambda c, d: spark.createDataFrame([(c, d)], "c array<string>, d array<string>").select(x.glycan_entry_tier(F.col("c"), F.col("d")).alias("t")).first().t
    assert tier(["reported", "reported_with_glycan"], []) == "glygen_reported_with_glycan"
    assert tier(["reported"], ["UniProtKB"]) == "glygen_reported_uniprot_derived" and tier(["reported"], ["PubMed"]) == "glygen_reported_independent"
    assert tier(["predicted_with_glycan"], []) == "glygen_predicted" and tier([], []) == "glygen_unclassified"


def test_sequons_overlap_and_short(spark):
    found = lambda s: one(spark, x.sequon_positions, s)
    assert found("NNSSTPNPTNAT") == [1, 2, 10] and found("NA") == [] and found("") == [] and found("ANA") == []


def test_labels_ids_codes(spark):
    assert one(spark, x.site_label_position, " asn-80 ") == 80 and one(spark, x.site_label_position, "Ser-3") is None
    assert one(spark, x.clean_ids, " 1ABC; ;2XYZ;") == ["1ABC", "2XYZ"]
    assert [one(spark, x.clean_icode, v) for v in (None, "nan", "?", " A ")] == ["", "", "", "A"]
    assert one(spark, x.gene_tokens, "abc; Def abc") == ["ABC", "DEF"]
    assert one(spark, x.normal_reason, "incomplete_backbone_at_model_index_[3, 4]") == "incomplete_backbone_at_model_index"


def test_verdict_touching_margin(spark):
    rows = spark.createDataFrame([(-0.2, 0.2), (0.21, 0.5), (0.05, 0.3), (-0.3, 0.3)], "a double, b double").select(x.verdict(F.col("a"), F.col("b"), F.lit(0.2)).alias("v")).collect()
    assert [r.v for r in rows] == ["equivalent", "beyond_margin", "directional", "inconclusive"]


def test_distributions_and_scores(spark):
    good = [1 / 21] * 21
    check = lambda v: one(spark, x.is_distribution, v, "array<double>")
    assert check(good) and not check([1.0] * 21) and not check([0.0] * 21) and not check([1.5, -0.5] + [0.0] * 19) and check([1.0005] + [0.0] * 20)
    s = spark.createDataFrame([(good,)], "v array<double>").select(x.sequon_score(F.col("v"), F.col("v")).alias("s")).first().s
    odds = lambda p: math.log(p / (1 - p))
    assert math.isclose(s, (odds(1 / 21) + odds(2 / 21)) / 2)
    assert math.isclose(one(spark, x.logit, 0.0, "double"), odds(1e-6))


def test_scoreable_and_batch(spark):
    rows = spark.createDataFrame([([True, True, False], [0, 1, 1]), ([True], [0, 1, 2]), ([True, False, True], [0, 1, 2])], "m array<boolean>, i array<int>").select(x.scoreable(F.col("m"), F.col("i")).alias("s")).collect()
    assert [r.s for r in rows] == [True, False, False]
    assert [one(spark, lambda c: x.batch_size(c, F.lit(32)), n, "int") for n in (0, 200, 1287, 9000)] == [32, 30, 4, 1]


def test_retention(spark):
    rows = spark.createDataFrame([(["NAS", "NPT", "AAS", "NAA", "AAA", "N"],), (["N"],)], "d array<string>").select(x.retention(F.col("d"), F.lit(0), F.lit(1), F.lit(2)).alias("r")).collect()
    r = rows[0].r
    assert (r.n_designs_scored, r.n_full_sequon_retained, r.n_asn_retained_motif_lost, r.n_ser_thr_retained_motif_lost, r.n_proline_introduced_at_x, r.n_complete_motif_loss) == (5, 1, 2, 2, 1, 1)
    assert rows[1].r.n_designs_scored == 0 and rows[1].r.frac_complete_motif_loss is None


def test_motifs_overlap(spark):
    r = random.Random(1)
    texts = ["", "N", "NN", "NAS", "NNSS", "NPT", "NPS", "NATNAS", "NNNSSS", "ANGT", None] + ["".join(r.choice("NPSTA") for _ in range(r.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", x.sequons(F.col("t")).alias("m"), x.sequon_count(F.col("t")).alias("n")).collect():
        want = [(m.start() + 1, row.t[m.start() : m.start() + 3]) for m in re.finditer("(?=N[^P][ST])", row.t or "")]
        assert [tuple(m) for m in row.m] == want and (row.n or 0) == len(want)


def test_half_even_is_that_of_the_binary_value(spark):
    r = random.Random(2)
    values = [2.675, 0.125, 0.375, -0.125, -2.675, 1.005, 0.5, 1e15 + 0.3, 1e300, 5e-324, 0.0] + [r.uniform(-1e3, 1e3) for _ in range(500)] + [r.randrange(-999, 999) / 2 ** r.randrange(1, 12) for _ in range(500)] + [round(r.uniform(-9, 9), 3) for _ in range(500)]
    for places in (2, 4, 5, 6):
        for row in spark.createDataFrame([(v,) for v in values], "v double").select("v", x.half_even(F.col("v"), places).alias("h")).collect():
            assert row.h == round(row.v, places), (row.v, places)
