"""Queries of the engine's own operators over the driver's tables, named by operator, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import exprs as x
from siteloom.operators import checks as ck
from siteloom.operators import controls as co
from siteloom.operators import evidence as ev
from siteloom.operators import graph
from siteloom.operators import inference as inf
from siteloom.operators import matching as ma
from siteloom.operators import scoring as sc
from siteloom.operators import sites as st
from siteloom.operators import structures as sr
from siteloom.plans import analogues as an
from siteloom.plans import registry, runs
from siteloom.plans.registry import add, r6, rounded
from siteloom.sources import readers as rd
from siteloom.sources import sinks as sk


def queries() -> dict[str, registry.Query]:
    from siteloom.plans import catalogue_io, catalogue_structures  # noqa: F401

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)


def _links(s: SparkSession, d: str) -> DataFrame:
    return st.associations(an.pairs(s, d), an.homology(s, d), ["line_no", "homology_qc_bucket"])


# -- scans, filters, universe ---------------------------------------------------------------------


@add("SRC3", "SELECT DISTINCT CAST(p_partkey AS VARCHAR) accession FROM part WHERE p_type = 'PROMO' AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def _(s, d):
    part = an.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("Entry"), F.when(F.col("p_type") == "PROMO", F.col("p_type")).otherwise(" ").alias("xref"))
    return rd.with_reference(part, an.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("accession")), "xref")


@add("SRC4", "SELECT CAST(o_custkey AS VARCHAR) accession, arg_max(o_orderpriority, o_orderkey) AS sequence FROM orders GROUP BY 1")
def _(s, d):
    rows = an.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("Entry"), F.col("o_orderpriority").alias("Sequence"), "o_orderkey")
    return rd.sequences(rows, rows.select(F.col("Entry").alias("accession")), "o_orderkey")


@add("SRC17", "SELECT CAST(doc_id AS VARCHAR) accession, unnest(list_sort([upper(v) FOR v IN [lang, source] IF upper(v) <> 'EN'])) pdb_id FROM documents")
def _(s, d):
    return rd.wanted_structures(an.proteins(s, d).select("accession", F.lit("en").alias("pdb_id"), F.col("pdb_ids").alias("all_pdb_ids")))


@add("FLT1", f"WITH {an.PAIRS} SELECT pair_id, pos_accession FROM pairs WHERE coalesce(analysis_ready, false)")
def _(s, d):
    return st.ready(an.pairs(s, d)).select("pair_id", "pos_accession")


@add("FLT2", f"WITH {an.PAIRS} SELECT count(*) FILTER (best_loss_positive_position IS NULL) n_missing FROM pairs WHERE analysis_ready")
def _(s, d):
    return st.missing_positions(st.ready(an.pairs(s, d)))


@add("FLT3", f"WITH {an.PAIRS} SELECT pos_accession accession, CAST(best_loss_positive_position AS INTEGER) AS position FROM pairs WHERE best_loss_positive_position IS NOT NULL")
def _(s, d):
    return st.positioned(an.pairs(s, d)).select("accession", "position")


@add("FLT4", "SELECT CAST(r_regionkey AS VARCHAR) accession, CAST(NULL AS VARCHAR) cluster_id FROM region")
def _(s, d):
    return st.with_missing(an.table(s, d, "region").select(F.col("r_regionkey").cast("string").alias("accession")), ("accession", "cluster_id"))


@add("FLT5", f"WITH {an.FEATURES} SELECT accession, position FROM features WHERE parse_status = 'ok' AND position IS NOT NULL AND glyco_type = 'N-linked'")
def _(s, d):
    return ev.usable_features(x.parse_features(an.annotations(s, d))).select("accession", "position")


@add("FLT10", "SELECT CAST(p_partkey AS VARCHAR) accession FROM part WHERE p_type = 'PROMO' AND p_size IS NOT NULL AND p_retailprice IS NOT NULL AND p_brand IS NOT NULL")
def _(s, d):
    return ma.usable(an.side(s, d, "PROMO"), ["size", "price"], ["brand"]).select("accession")


@add("FLT12", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')")
def _(s, d):
    keys = an.table(s, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_partkey").alias("p_partkey"))
    return st.in_keys(an.table(s, d, "part").select("p_partkey", "p_brand"), keys, ["p_partkey"])


@add("FLT13", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(s, d):
    return st.not_in_keys(an.table(s, d, "customer").select("c_custkey"), an.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@add("FLT14", "SELECT p_partkey, p_brand FROM (SELECT *, dense_rank() OVER (ORDER BY p_brand, p_type) - 1 g FROM part) WHERE g % 4 = 1")
def _(s, d):
    return st.shard(an.table(s, d, "part"), ["p_brand", "p_type"], "1/4").select("p_partkey", "p_brand")


@add("FLT15", f"WITH {an.VECTORS}, v AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(p, lambda q: q * 2) ELSE p END p FROM vectors) SELECT vec_id FROM v WHERE NOT (abs(list_sum(p) - 1) <= 1e-3 AND list_min(p) >= 0 AND list_max(p) <= 1.001)")
def _(s, d):
    rows = an.vectors(s, d).withColumn("p", F.when(F.col("vec_id") % 3 == 0, F.transform("p", lambda q: q * 2)).otherwise(F.col("p")))
    return rows.where(~x.is_distribution(F.col("p"))).select("vec_id")


@add("FLT17", "SELECT CAST(p_partkey AS VARCHAR) Entry FROM part WHERE p_size > 10 AND p_type <> 'PROMO' AND p_brand <> 'Brand#1' AND p_brand <> 'Brand#2'")
def _(s, d):
    part = an.table(s, d, "part")
    key = F.when(F.col("p_brand") == "Brand#1", "KW-0732").when(F.col("p_brand") == "Brand#2", "KW-0812").otherwise("none")
    rows = part.select(F.col("p_partkey").cast("string").alias("Entry"), (F.col("p_size") > 10).alias("reviewed"), F.lit(True).alias("has_structure"), F.array(F.lit(2759)).alias("taxonomy_ids"), F.array(key, F.when(F.col("p_type") == "PROMO", "KW-0325").otherwise("x")).alias("keywords"), F.array(F.lit("0005829")).alias("go_ids"))
    return rd.control_set(rows, "cytosolic_eukaryotic").select("Entry")


@add("AGG1", f"WITH {an.SITES} SELECT DISTINCT accession, position FROM links")
def _(s, d):
    return st.candidate_sites(an.pairs(s, d))


@add("DDP1", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) o_orderkey FROM orders GROUP BY 1")
def _(s, d):
    return st.keep_first(an.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@add("DDP6", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(s, d):
    return st.keep_first(an.table(s, d, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], ["l_partkey"])


@add("JN1", f"WITH {an.ASSOCIATED} SELECT accession, position, pair_id, cluster_id, neg_accession, source, homology_qc_bucket FROM associated")
def _(s, d):
    return _links(s, d)


@add("AGG2", f"WITH {an.ASSOCIATED} SELECT accession, position, bool_or(homology_qc_bucket = 'strict') in_strict, bool_or(homology_qc_bucket IN ('strict','plausible')) in_strict_plus_plausible, count(pair_id) n_associations FROM associated GROUP BY 1, 2")
def _(s, d):
    return st.subsets(_links(s, d))


@add("AGG4", f"WITH {an.SITES} SELECT count(*) n_sites, count(DISTINCT accession) n_proteins FROM (SELECT DISTINCT accession, position FROM links)")
def _(s, d):
    return st.counts(st.candidate_sites(an.pairs(s, d)))


@add("AGG8", f"WITH {an.SITES}, c AS (SELECT accession, position, list_sort(list(DISTINCT cluster_id))[1:3] ids FROM links GROUP BY 1, 2) SELECT accession, position, array_to_string(ids, ';') ortholog_clusters FROM c")
def _(s, d):
    return st.clusters(_links(s, d))


@add("AGG11", "SELECT l_returnflag, l_linestatus, count(*) n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return st.crosstab(an.table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@add("SRT1", f"WITH {an.SITES} SELECT DISTINCT accession, position FROM links ORDER BY 1, 2")
def _(s, d):
    return st.candidate_sites(an.pairs(s, d)).orderBy(F.asc_nulls_last("accession"), F.asc_nulls_last("position"))


@add("SET1", "SELECT CAST(c_custkey AS BIGINT) AS key, c_acctbal balance, c_mktsegment segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(s, d):
    a = an.table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return st.stacked([a, an.table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))])


@add("SNK8", "SELECT o_orderkey, o_custkey FROM orders")
def _(s, d):
    rows = an.table(s, d, "orders").select("o_orderkey", "o_custkey")
    return st.merged_shards([rows.where("o_custkey < 500"), rows.where("o_custkey >= 400")], ["o_orderkey"], ["o_custkey"])


@add("AGG32", "SELECT count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) merged, count(*) expected, round(100.0 * count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) / count(*), 6) coverage FROM part")
def _(s, d):
    return sk.merge_report(an.table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), an.table(s, d, "part"), ["p_partkey"]).withColumn("coverage", F.round("coverage", 6))


# -- evidence -------------------------------------------------------------------------------------


@add("FN6", f"WITH {an.FEATURES} SELECT accession, coalesce(position, -1) AS position, glyco_type, coalesce(code, '') codes, parse_status FROM features")
def _(s, d):
    return x.parse_features(an.annotations(s, d)).select("accession", F.coalesce("position", F.lit(-1)).alias("position"), "glyco_type", F.array_join("evidence_codes", "|").alias("codes"), "parse_status")


@add("AGG3", f"WITH {an.FEATURES} SELECT accession, position, string_agg(DISTINCT code, '|' ORDER BY code) codes FROM features WHERE parse_status = 'ok' GROUP BY 1, 2")
def _(s, d):
    return ev.code_union(x.parse_features(an.annotations(s, d)).where("parse_status = 'ok'")).select("accession", "position", F.array_join("codes", "|").alias("codes"))


@add("CMP3", f"WITH {an.FEATURES} SELECT accession, coalesce(position, -1) AS position, glyco_type, parse_status, {an.TIER} tier FROM features")
def _(s, d):
    return ev.feature_inventory(x.parse_features(an.annotations(s, d))).select("accession", F.coalesce("position", F.lit(-1)).alias("position"), "glyco_type", "parse_status", "tier")


_LAYER = f"""{an.FEATURES}, {an.FEATURE_SITES}, layer AS (SELECT s.accession, s.position, CASE WHEN s.accession LIKE 'x%' THEN '' WHEN f.code IS NULL THEN 'exact_feature_absent' ELSE {an.TIER} END uniprot_tier,
  coalesce(f.code, '') uniprot_evidence_codes, s.accession LIKE 'x%' gone FROM sites s LEFT JOIN (SELECT * FROM features WHERE parse_status = 'ok' AND glyco_type = 'N-linked') f ON s.accession = f.accession AND s.position = f.position),
annotated AS (SELECT accession, position, uniprot_tier, uniprot_evidence_codes, uniprot_tier IN ('manual_experimental','manual_combinatorial') uniprot_qualifies,
  CASE WHEN gone THEN 'accession_absent_from_snapshot' WHEN uniprot_tier IN ('manual_experimental','manual_combinatorial') THEN '' WHEN uniprot_tier = 'manual_curator_inference' THEN 'curator_inference_only'
  WHEN uniprot_tier IN ('manual_sequence_model','automatic_sequence_model') THEN 'sequence_model_only' WHEN uniprot_tier = 'sequence_similarity' THEN 'sequence_similarity_only' ELSE uniprot_tier END exclusion_reason FROM layer)"""


def _annotated(s: SparkSession, d: str) -> DataFrame:
    sites = an.feature_sites(s, d)
    absent = sites.select("accession").join(an.annotations(s, d), "accession", "left_anti")
    return ev.annotation_layer(sites, x.parse_features(an.annotations(s, d)), absent, ev.Policy())


@add("JN2", f"WITH {_LAYER} SELECT accession, position, uniprot_tier, uniprot_evidence_codes, uniprot_qualifies, exclusion_reason FROM annotated")
def _(s, d):
    return _annotated(s, d)


_GLYCAN = f"""{an.ENTRIES}, glycan AS (SELECT accession, position, {an.GLYCAN_TIERS}[min(rank) + 1] glygen_tier, string_agg(DISTINCT category, '|' ORDER BY category) glygen_categories, string_agg(DISTINCT db, '|' ORDER BY db) glygen_evidence_databases,
  coalesce(string_agg(DISTINCT CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR)) FILTER (db = 'PubMed'), '') glygen_pubmed_ids, string_agg(DISTINCT 'G' || event_id % 5, '|' ORDER BY 'G' || event_id % 5) glygen_glytoucan_ids FROM entries GROUP BY 1, 2)"""


@add("AGG6", f"WITH {_GLYCAN} SELECT * FROM glycan")
def _(s, d):
    return ev.glycan_sites(an.glycan_entries(s, d))


@add("AGG7", "SELECT CAST(user_id AS VARCHAR) accession, CAST(json_extract_string(props, '$.k') AS INTEGER) AS position, count(*) glyconnect_glycan_count, string_agg(DISTINCT event_type, '|' ORDER BY event_type) glyconnect_compositions FROM events GROUP BY 1, 2")
def _(s, d):
    rows = an.table(s, d, "events").select(F.col("user_id").cast("string").alias("accession"), F.col("event_type").alias("composition_string"), F.array(F.struct(F.concat(F.lit(" asn-"), F.get_json_object("props", "$.k"), F.lit(" ")).alias("site"))).alias("sites"))
    return ev.composition_sites(rows)


_USERS = "users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) accession, p AS position FROM events, (SELECT unnest([1, 2, 3, 50]) p))"


def _user_sites(s: SparkSession, d: str) -> DataFrame:
    return an.table(s, d, "events").select(F.col("user_id").cast("string").alias("accession")).distinct().withColumn("position", F.explode(F.array(*map(F.lit, (1, 2, 3, 50)))))


@add("JN5", f"WITH {_GLYCAN}, {_USERS} SELECT accession, position, coalesce(glygen_tier, '') glygen_tier, coalesce(glygen_categories, '') glygen_categories FROM users LEFT JOIN glycan USING (accession, position)")
def _(s, d):
    return ev.layer_on_sites(_user_sites(s, d), ev.glycan_sites(an.glycan_entries(s, d))).select("accession", "position", "glygen_tier", "glygen_categories")


_COMBINED = f"""{_LAYER}, {_GLYCAN}, joined AS (SELECT a.*, coalesce(g.glygen_tier, '') glygen_tier, coalesce(g.glygen_tier, '') IN ('glygen_reported_with_glycan','glygen_reported_independent') g FROM annotated a LEFT JOIN glycan g USING (accession, position)),
combined AS (SELECT accession, position, concat_ws('|', CASE WHEN uniprot_qualifies THEN 'uniprot' END, CASE WHEN g THEN 'glygen' END) support_sources, CAST(uniprot_qualifies AS INTEGER) + CAST(g AS INTEGER) support_count,
  uniprot_qualifies OR g experimental_positive, CASE WHEN uniprot_qualifies OR g THEN 'occupied_supported' ELSE 'unknown' END occupancy_status, CASE WHEN uniprot_qualifies OR g THEN '' ELSE exclusion_reason END exclusion_reason FROM joined)"""


def _combined(s: SparkSession, d: str) -> DataFrame:
    return ev.combine(_annotated(s, d), [ev.layer_on_sites(an.feature_sites(s, d), ev.glycan_sites(an.glycan_entries(s, d)))], ev.Policy())


@add("CMP2", f"WITH {_COMBINED} SELECT * FROM combined")
def _(s, d):
    return _combined(s, d).select("accession", "position", "support_sources", "support_count", "experimental_positive", "occupancy_status", "exclusion_reason")


@add("AGG5", f"WITH {_COMBINED} SELECT count(*) FILTER (support_sources LIKE '%uniprot%') n_uniprot, count(*) FILTER (support_sources LIKE '%glygen%') n_glygen, CAST(0 AS BIGINT) n_glyconnect, CAST(0 AS BIGINT) n_structure FROM combined")
def _(s, d):
    return ev.layer_support(_combined(s, d))


@add("AGG28", f"WITH {_COMBINED} SELECT count(*) n_all, count(*) FILTER (experimental_positive) n_positive, count(*) FILTER (support_count = 2) n_both FROM combined")
def _(s, d):
    return _combined(s, d).agg(F.count("*").alias("n_all"), F.count_if("experimental_positive").alias("n_positive"), F.count_if(F.col("support_count") == 2).alias("n_both"))


# -- sequences ------------------------------------------------------------------------------------

_MOTIFS = f"{an.PROTEINS}, motifs AS (SELECT accession, control_set, pdb_ids, sequence, CAST(i AS INTEGER) AS position FROM (SELECT *, unnest(range(1, greatest(length(sequence) - 1, 1))) i FROM proteins) WHERE sequence[i] = 'N' AND sequence[i + 1] <> 'P' AND sequence[i + 2] IN ('S', 'T'))"


@add("FN15", f"WITH {_MOTIFS} SELECT accession, position FROM motifs")
def _(s, d):
    return an.proteins(s, d).select("accession", F.explode(x.sequon_positions(F.col("sequence"))).alias("position"))


@add("FN16", f"WITH {_MOTIFS} SELECT accession, control_set, position, sequence[position:position + 2] sequon, CAST(length(sequence) AS INTEGER) protein_length, CAST(2 AS INTEGER) n_pdb_entries, replace(pdb_ids, '; ', ';') pdb_ids FROM motifs")
def _(s, d):
    return x.sequon_sites(an.proteins(s, d))


@add("AGG9", f"WITH {an.PROTEINS}, letters AS (SELECT unnest(string_split(sequence, '')) letter FROM proteins WHERE sequence <> '') SELECT letter, round(count(*) / sum(count(*)) OVER (), 5) AS share FROM letters GROUP BY 1")
def _(s, d):
    return co.composition(an.proteins(s, d)).select("letter", F.round("share", 5).alias("share"))


_LETTERS = ",".join(f"sum(length(sequence) - length(replace(sequence, '{c}', '')))" for c in co.LETTERS)


@add("AGG10", f"""WITH {_MOTIFS}, m AS (SELECT accession, count(*) k FROM motifs GROUP BY 1), p AS (SELECT * FROM proteins LEFT JOIN m USING (accession))
SELECT control_set, count(*) proteins, CAST(sum(coalesce(k, 0)) AS BIGINT) sequons, round(sum(coalesce(k, 0)) / count(*), 3) per_protein, CASE WHEN sum(length(sequence)) > 0 THEN round(1000 * sum(coalesce(k, 0)) / sum(length(sequence)), 3) END per_1000_residues, count(k) proteins_with_motif,
count(*) FILTER (k > 0 AND len(list_filter(string_split(coalesce(pdb_ids, ''), ';'), lambda e: trim(e) <> '')) > 0) proteins_with_structure, concat_ws(',', {_LETTERS}) letters FROM p GROUP BY 1""")
def _(s, d):
    return co.control_summary(an.proteins(s, d))


@add("FN31", "SELECT p_partkey, list_sort(list_distinct(string_split(upper(p_name), ' '))) tokens FROM part")
def _(s, d):
    return an.table(s, d, "part").select("p_partkey", F.array_sort(x.gene_tokens(F.col("p_name"))).alias("tokens"))


@add("FN32", "SELECT doc_id, regexp_matches(text, '(?i)\\b(immunoglobulin|antibody|Fc receptor|mucin|collagen|integrin|cadherin|complement C[0-9]|coagulation factor|fibrinogen|von Willebrand|histocompatibility|growth factor receptor)\\b') suspect FROM documents")
def _(s, d):
    return an.table(s, d, "documents").select("doc_id", x.suspect_family(F.col("text")).alias("suspect"))


@add("JN21", "SELECT p_partkey, len(list_intersect(string_split(upper(p_name), ' '), (SELECT list(DISTINCT t) FROM (SELECT unnest(string_split(upper(p_name), ' ')) t FROM part WHERE p_type = 'PROMO')))) > 0 shared FROM part")
def _(s, d):
    part = an.table(s, d, "part")
    genes = part.where("p_type = 'PROMO'").select(F.explode(x.gene_tokens(F.col("p_name"))).alias("g")).distinct()
    hit = part.select("p_partkey", F.explode(x.gene_tokens(F.col("p_name"))).alias("g")).join(genes, "g", "left_semi").select("p_partkey", F.lit(True).alias("hit")).distinct()
    return part.select("p_partkey").join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("shared"))


@add("AGG29", "SELECT n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def _(s, d):
    rows = an.table(s, d, "customer").join(an.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return st.most_common(rows.select(F.split("n_name", r" \(")[0].alias("n_name")), "n_name", 4)


@add("AGG33", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) first_priority FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(s, d):
    rows = an.table(s, d, "orders").withColumn("first_priority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return st.first_known(rows, ["o_custkey"], "first_priority", ["o_orderkey"])


# -- matching -------------------------------------------------------------------------------------


def _edges(s: SparkSession, d: str) -> DataFrame:
    return ma.caliper_edges(an.side(s, d, "PROMO"), an.side(s, d, "ECONOMY"), *_MATCHED)


_MATCHED = (["size", "price"], 0.25, ("brand",))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    return ma.nearest_controls(an.side(s, d, "PROMO"), an.side(s, d, "ECONOMY"), *_MATCHED, 3)


@add("JN12", f"WITH {an.NEAR} SELECT case_accession, control_accession, brand, round(distance, 6) distance FROM near")
def _(s, d):
    return _edges(s, d).select("case_accession", "control_accession", "brand", r6("distance"))


@add("SRT3", f"WITH {an.NEAREST} SELECT case_accession, control_accession, round(distance, 6) distance, CAST(match_rank AS INTEGER) match_rank FROM nearest WHERE match_rank <= 3")
def _(s, d):
    return _nearest(s, d).select("case_accession", "control_accession", r6("distance"), "match_rank")


@add("FN37", "SELECT round(stddev_samp(p_size), 6) AS size, round(stddev_samp(p_retailprice), 6) price FROM part WHERE p_type IN ('PROMO','ECONOMY')")
def _(s, d):
    scale = ma.scales(an.side(s, d, "PROMO"), an.side(s, d, "ECONOMY"), ["size", "price"])
    return s.createDataFrame([(round(scale["size"], 6), round(scale["price"], 6))], "size double, price double")


def _greedy_sql(seeds: str, k: int) -> str:
    """Cases one by one in the order of their digests, each with the nearest controls that nobody has taken."""
    return f"""WITH RECURSIVE {an.NEAR}, seeds AS (SELECT unnest({seeds}) AS seed), turns AS (SELECT seed, case_accession, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '-' || case_accession || '-1'), case_accession) i FROM (SELECT DISTINCT case_accession FROM near), seeds),
lists AS (SELECT seed, i, any_value(case_accession) c, list(control_accession ORDER BY distance, control_accession) l FROM near JOIN turns USING (case_accession) GROUP BY 1, 2),
walk AS (SELECT seed, CAST(0 AS BIGINT) i, CAST([] AS VARCHAR[]) got, CAST([] AS VARCHAR[]) taken, '' c FROM seeds UNION ALL
  SELECT w.seed, lists.i, list_filter(l, lambda y: NOT list_contains(taken, y))[1:{k}], list_concat(taken, list_filter(l, lambda y: NOT list_contains(taken, y))[1:{k}]), lists.c FROM walk w JOIN lists ON lists.seed = w.seed AND lists.i = w.i + 1),
pairs AS (SELECT seed, c case_accession, unnest(got) control_accession, generate_subscripts(got, 1) match_rank FROM walk)"""


@add("STAT13", _greedy_sql("[0]", 5) + " SELECT case_accession, control_accession, CAST(match_rank AS INTEGER) match_rank FROM pairs")
def _(s, d):
    return ma.greedy_controls(an.side(s, d, "PROMO"), an.side(s, d, "ECONOMY"), *_MATCHED).select("case_accession", "control_accession", "match_rank")


# cases and controls of a brand and a band of sizes are bounded groups, most of them contested; the SQL tries every choice
_BAND = "CAST(floor(p_size / 5) AS INTEGER)"
_CHOICES = f"""scale AS (SELECT stddev_samp(p_retailprice) r FROM part WHERE p_type IN ('PROMO','ECONOMY')),
near AS (SELECT a.p_brand brand, {_BAND.replace('p_', 'a.p_')} band, a.p_partkey a, b.p_partkey b, abs(a.p_retailprice - b.p_retailprice) / r distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND {_BAND.replace('p_', 'a.p_')} = {_BAND.replace('p_', 'b.p_')}, scale
  WHERE a.p_type = 'PROMO' AND b.p_type = 'ECONOMY' AND abs(a.p_retailprice - b.p_retailprice) / r <= 0.8),
turns AS (SELECT brand, band, a, row_number() OVER (PARTITION BY brand, band ORDER BY a) i FROM (SELECT DISTINCT brand, band, a FROM near)),
lists AS (SELECT brand, band, i, list({{'b': b, 'd': distance}}) l FROM near JOIN turns USING (brand, band, a) GROUP BY 1, 2, 3),
tried AS (SELECT brand, band, CAST(0 AS BIGINT) i, CAST([] AS BIGINT[]) taken, CAST(0 AS DOUBLE) total FROM (SELECT DISTINCT brand, band FROM near) UNION ALL
  SELECT t.brand, t.band, n.i, CASE WHEN e IS NULL THEN taken ELSE list_append(taken, CAST(e.b AS BIGINT)) END, total + coalesce(e.d, 0) FROM tried t JOIN lists n ON n.brand = t.brand AND n.band = t.band AND n.i = t.i + 1, unnest(list_append(n.l, NULL)) u(e) WHERE e IS NULL OR NOT list_contains(taken, CAST(e.b AS BIGINT))),
best AS (SELECT brand, band, len(taken) n_pairs, total, row_number() OVER (PARTITION BY brand, band ORDER BY len(taken) DESC, total) place FROM tried t WHERE i = (SELECT max(i) FROM turns x WHERE x.brand = t.brand AND x.band = t.band))"""


@add("STAT14", f"WITH RECURSIVE {_CHOICES} SELECT brand, band, CAST(n_pairs AS BIGINT) n_pairs, round(total, 4) total_distance FROM best WHERE place = 1")
def _(s, d):
    """Pairs and total distance of each brand and band of sizes, in which cases compete for controls."""
    rows = {k: an.side(s, d, k).withColumn("band", F.floor(F.col("size") / 5).cast("int")) for k in ("PROMO", "ECONOMY")}
    pairs = ma.optimal_controls(rows["PROMO"], rows["ECONOMY"], ["price"], 0.8, ("brand", "band"))
    return pairs.groupBy("brand", "band").agg(F.count("*").alias("n_pairs"), F.round(F.sum("distance"), 4).alias("total_distance"))


# as many seeds and draws as the reference takes
_SEEDS, _SWEEP_DRAWS = list(range(200)), 2000
_VERDICTS = ("equivalent", "beyond_margin", "directional", "inconclusive")
_SWEEP = f"""{_greedy_sql(str(_SEEDS), 1)}, {an.SCORES}, contrasts AS (SELECT seed, case_accession, a.score - b.score contrast FROM pairs JOIN scores a ON case_accession = a.accession JOIN scores b ON control_accession = b.accession),
units AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY case_accession) - 1 unit_at, count(*) OVER (PARTITION BY seed) u FROM contrasts),
means AS (SELECT p.seed, draw, avg(contrast) m FROM (SELECT seed, draw, CAST(('0x' || substr(md5('sweep-' || seed || '-' || draw || '-' || unit_at), 1, 8)) AS BIGINT) % u unit_at FROM units, (SELECT unnest(range({_SWEEP_DRAWS})) draw)) p JOIN units USING (seed, unit_at) GROUP BY 1, 2),
ends AS (SELECT seed, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high FROM means GROUP BY 1),
swept AS (SELECT seed, count(*) n_pairs, avg(contrast) mean, any_value(ci_low) ci_low, any_value(ci_high) ci_high FROM contrasts JOIN ends USING (seed) GROUP BY 1),
judged AS (SELECT *, CASE WHEN ci_low >= -margin AND ci_high <= margin THEN 'equivalent' WHEN ci_low > margin OR ci_high < -margin THEN 'beyond_margin' WHEN ci_low > 0 OR ci_high < 0 THEN 'directional' ELSE 'inconclusive' END verdict FROM swept, (SELECT 0.2 * stddev_samp(score) margin FROM scores))"""


@add("STAT15", _SWEEP + " SELECT count(*) n_seeds, min(n_pairs) min_pairs, max(n_pairs) max_pairs, round(min(mean), 4) min_mean, round(median(mean), 4) median_mean, round(max(mean), 4) max_mean, bool_and(mean > 0) all_positive, round(avg(CAST(ci_low > 0 OR ci_high < 0 AS INTEGER)), 6) share_excluding_zero, round(min(ci_low), 4) least_low, round(max(ci_high), 4) most_high, " + ", ".join(f"count(*) FILTER (verdict = '{c}') n_{c}" for c in _VERDICTS) + " FROM judged")
def _(s, d):
    """Greedy pairs under 200 seeds, their contrasts, units, 2,000 draws each, intervals and verdicts, to one row."""
    swept = graph.cut(inf.greedy_sweep(an.side(s, d, "PROMO"), an.side(s, d, "ECONOMY"), an.scores(s, d), None, *_MATCHED, 1, tuple(_SEEDS), _SWEEP_DRAWS))
    ends = swept.agg(F.round(F.min("ci_low"), 4).alias("least_low"), F.round(F.max("ci_high"), 4).alias("most_high"), *(F.count_if(F.col("verdict") == c).alias(f"n_{c}") for c in _VERDICTS))
    return inf.sweep_summary(swept).select("n_seeds", "min_pairs", "max_pairs", *(F.round(c, 4).alias(c) for c in ("min_mean", "median_mean", "max_mean")), "all_positive", r6("share_excluding_zero")).crossJoin(F.broadcast(ends))  # one row each


_BALANCE = """SELECT feature, round(cm, 6) case_mean, round(tm, 6) control_mean, round((cm - tm) / sqrt((cv + tv) / 2), 6) smd FROM (
  SELECT 'size' feature, avg(p_size) FILTER (p_type = 'PROMO') cm, avg(p_size) FILTER (p_type <> 'PROMO') tm, var_samp(p_size) FILTER (p_type = 'PROMO') cv, var_samp(p_size) FILTER (p_type <> 'PROMO') tv FROM part
  UNION ALL SELECT 'price', avg(p_retailprice) FILTER (p_type = 'PROMO'), avg(p_retailprice) FILTER (p_type <> 'PROMO'), var_samp(p_retailprice) FILTER (p_type = 'PROMO'), var_samp(p_retailprice) FILTER (p_type <> 'PROMO') FROM part)"""


@add("AGG14", _BALANCE)
def _(s, d):
    part = an.table(s, d, "part").select((F.col("p_type") == "PROMO").alias("is_case"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return ma.balance(part, ["size", "price"]).select("feature", r6("case_mean"), r6("control_mean"), r6("smd"))


_WEIGHTED = f"""WITH {an.NEAREST}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY case_accession) w FROM nearest WHERE match_rank <= 3),
g AS (SELECT true is_case, w, p_size x FROM w JOIN part ON case_accession = CAST(p_partkey AS VARCHAR) UNION ALL SELECT false, w, p_size FROM w JOIN part ON control_accession = CAST(p_partkey AS VARCHAR)),
m AS (SELECT is_case, sum(w * x) / sum(w) m FROM g GROUP BY 1), v AS (SELECT is_case, any_value(m) m, sum(w * (x - m) ** 2) / sum(w) v FROM g JOIN m USING (is_case) GROUP BY 1)
SELECT round(max(m) FILTER (is_case), 6) case_mean, round(max(m) FILTER (NOT is_case), 6) control_mean, round((max(m) FILTER (is_case) - max(m) FILTER (NOT is_case)) / sqrt(sum(v) / 2), 6) smd FROM v"""


@add("AGG16", _WEIGHTED)
def _(s, d):
    pairs = ma.case_weights(_nearest(s, d))
    size = an.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("a"), F.col("p_size").alias("size"))
    rows = [pairs.join(size, pairs[f"{k}_accession"] == size.a).select(F.lit(k == "case").alias("is_case"), "weight", "size") for k in ("case", "control")]
    return ma.balance(rows[0].unionAll(rows[1]), ["size"], weight="weight").select(r6("case_mean"), r6("control_mean"), r6("smd"))


@add("DQ6", f"WITH {an.NEAREST}, w AS (SELECT 1.0 / count(*) OVER (PARTITION BY case_accession) w, case_accession FROM nearest WHERE match_rank <= 3) SELECT round(sum(w), 6) total_weight, count(DISTINCT case_accession) n_cases FROM w")
def _(s, d):
    return ma.case_weights(_nearest(s, d)).agg(F.round(F.sum("weight"), 6).alias("total_weight"), F.countDistinct("case_accession").alias("n_cases"))


@add("DQ9", f"WITH {an.NEAR} SELECT CAST(count(*) FILTER (a.p_brand <> b.p_brand) AS BIGINT) n_unequal FROM near JOIN part a ON case_accession = CAST(a.p_partkey AS VARCHAR) JOIN part b ON control_accession = CAST(b.p_partkey AS VARCHAR)")
def _(s, d):
    brand = an.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_brand").alias("b"))
    rows = _edges(s, d).join(brand.toDF("case_accession", "b1"), "case_accession").join(brand.toDF("control_accession", "b2"), "control_accession")
    return rows.agg(F.count_if(F.col("b1") != F.col("b2")).alias("n_unequal"))


@add("DQ4", "SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def _(s, d):
    return ck.shared_between(an.table(s, d, "part"), "p_name", "p_type")


@add("DQ1", "SELECT count(*) n_rows, count(*) FILTER (n_chars <> length(text)) n_disagree FROM documents JOIN labels USING (doc_id)")
def _(s, d):
    rows = an.table(s, d, "documents").join(an.table(s, d, "labels"), "doc_id")
    return ck.disagreements(rows, F.col("n_chars"), F.length("text").cast("long"))


@add("DQ7", "SELECT CAST(count(*) AS BIGINT) n_groups, CAST(count(*) AS BIGINT) n_in_one_shard FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def _(s, d):
    part, group = an.table(s, d, "part"), ["p_brand", "p_type"]
    return ck.in_one_part([st.shard(part, group, f"{k}/3") for k in range(3)], group)


# -- contrasts and inference ----------------------------------------------------------------------

_CONTRASTS = f"""{an.NEAREST}, {an.SCORES}, contrasts AS (SELECT case_accession, any_value(a.score) case_score, avg(b.score) control_mean_score, count(*) n_controls, string_agg(DISTINCT control_accession, ';' ORDER BY control_accession) control_proteins
  FROM nearest JOIN scores a ON case_accession = a.accession JOIN scores b ON control_accession = b.accession WHERE match_rank <= 3 GROUP BY 1)"""


def _contrasts(s: SparkSession, d: str) -> DataFrame:
    return inf.contrasts(_nearest(s, d), an.scores(s, d))


@add("AGG17", f"WITH {_CONTRASTS} SELECT case_accession, round(case_score - control_mean_score, 4) contrast, n_controls, control_proteins, 'solo:' || case_accession ortholog_cluster FROM contrasts")
def _(s, d):
    return _contrasts(s, d).select("case_accession", rounded("contrast", 4).alias("contrast"), "n_controls", "control_proteins", "ortholog_cluster")


@add("AGG18", f"WITH {_CONTRASTS} SELECT control, count(*) AS count FROM (SELECT unnest(string_split(control_proteins, ';')) control FROM contrasts) GROUP BY 1")
def _(s, d):
    return inf.control_reuse(_contrasts(s, d))


@add("STAT6", "SELECT 'c:' || o_custkey node, 'c:' || o_custkey component FROM orders UNION SELECT 'o:' || o_orderkey, 'c:' || o_custkey FROM orders")
def _(s, d):
    edges = an.table(s, d, "orders").select(F.concat(F.lit("c:"), "o_custkey").alias("a"), F.concat(F.lit("o:"), "o_orderkey").alias("b"))
    return graph.components(edges)


@add("AGG12", "SELECT round(stddev_samp(l_extendedprice), 4) reference_sd FROM lineitem")
def _(s, d):
    return inf.reference_sd(an.table(s, d, "lineitem"), "l_extendedprice").select(F.round("reference_sd", 4).alias("reference_sd"))


_LOCATION = """WITH r AS (SELECT c_acctbal v, row_number() OVER (ORDER BY c_acctbal) i, count(*) OVER () n, sum(c_acctbal) OVER () t FROM customer)
SELECT CAST(max(n) AS BIGINT) n, round(avg(v), 4) mean, round(median(v), 4) median, round(avg(v) FILTER (i > floor(n * 0.1) AND i <= n - floor(n * 0.1)), 4) trimmed_mean, count(*) FILTER (v > 0) n_positive,
round((max(t) - max(v)) / (max(n) - 1), 4) loo_min, round((max(t) - min(v)) / (max(n) - 1), 4) loo_max FROM r"""


@add("AGG20", _LOCATION)
def _(s, d):
    rows = inf.robust_location(an.table(s, d, "customer"), "c_acctbal")
    return rows.select("n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "trimmed_mean")), "n_positive", F.round("loo_min", 4).alias("loo_min"), F.round("loo_max", 4).alias("loo_max"))


@add("AGG19", "SELECT c_mktsegment, count(*) n, round(avg(c_acctbal), 4) mean, round(avg(c_acctbal) / stddev_samp(c_acctbal), 6) in_sd FROM customer GROUP BY 1")
def _(s, d):
    return inf.subtypes(an.table(s, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", "n", F.round("mean", 4).alias("mean"), r6("in_sd"))


_CLASSES = "SELECT coalesce(CAST(quality AS VARCHAR), '') || coalesce(CAST(toxic AS VARCHAR), '') AS class, n_chars, source FROM documents LEFT JOIN labels USING (doc_id)"


def _classes(s: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return an.table(s, d, "documents").join(an.table(s, d, "labels"), "doc_id", "left").select(F.concat(text("quality"), text("toxic")).alias("class"), "n_chars", "source")


@add("AGG21", f"""WITH c AS ({_CLASSES}), units AS (SELECT class, s, n, row_number() OVER (PARTITION BY class ORDER BY source) - 1 unit_at, count(*) OVER (PARTITION BY class) u FROM (SELECT class, source, sum(n_chars) s, count(*) n FROM c GROUP BY 1, 2)),
means AS (SELECT p.class, draw, sum(s) / sum(n) m FROM (SELECT class, draw, CAST(('0x' || substr(md5('class-' || class || '-' || draw || '-' || unit_at), 1, 8)) AS BIGINT) % u unit_at FROM units, (SELECT unnest(range(100)) draw)) p JOIN units USING (class, unit_at) GROUP BY 1, 2),
ends AS (SELECT class, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high FROM means GROUP BY 1)
SELECT class, count(*) n_sites, count(DISTINCT source) n_proteins, round(avg(n_chars), 4) mean, round(avg(CAST(n_chars = 0 AS INTEGER)), 6) share_zero, round(any_value(ci_low), 4) ci_low, round(any_value(ci_high), 4) ci_high FROM c JOIN ends USING (class) GROUP BY 1""")
def _(s, d):
    rows = inf.class_summary(_classes(s, d), ["class"], "n_chars", "source", 100)
    return rows.select("class", "n_sites", "n_proteins", F.round("mean", 4).alias("mean"), r6("share_zero"), F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"))


@add("AGG22", f"WITH c AS (SELECT class, avg(n_chars) m FROM ({_CLASSES}) GROUP BY 1) SELECT c.class, round(b.m - c.m, 4) difference FROM c, (SELECT m FROM c WHERE class = '10') b")
def _(s, d):
    summary = inf.class_summary(_classes(s, d), ["class"], "n_chars", "source")
    return inf.against_baseline(summary, "class", "10").select("class", F.round("difference", 4).alias("difference"))


@add("JN9", "SELECT doc_id, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE '' END status, coalesce(toxic = 0, false) scoreable FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    labels = an.table(s, d, "labels")
    status = labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("status"))
    known = labels.select("doc_id", (F.col("toxic") == 0).alias("scoreable"))
    return inf.with_status(an.table(s, d, "documents").select("doc_id"), status, known, ["doc_id"])


@add("AGG23", "SELECT count(*) n, count(*) FILTER (l_discount <> l_tax) n_informative, count(*) FILTER (l_discount = l_tax) n_tied, round(avg(l_discount), 6) mean_case, round(avg(l_tax), 6) mean_control, round(avg(l_discount - l_tax), 6) mean_difference FROM lineitem")
def _(s, d):
    return inf.paired_summary(an.table(s, d, "lineitem"), "l_discount", "l_tax").select("n", "n_informative", "n_tied", r6("mean_case"), r6("mean_control"), r6("mean_difference"))


_NATIONS = "n AS (SELECT c_nationkey k, count(*) n_pairs, avg(c_acctbal) mean, avg(c_acctbal) - 2 * stddev_samp(c_acctbal) / sqrt(count(*)) ci_low, avg(c_acctbal) + 2 * stddev_samp(c_acctbal) / sqrt(count(*)) ci_high FROM customer GROUP BY 1)"


def _nations(s: SparkSession, d: str) -> DataFrame:
    se = 2 * F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))
    return an.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_pairs"), F.avg("c_acctbal").alias("mean"), (F.avg("c_acctbal") - se).alias("ci_low"), (F.avg("c_acctbal") + se).alias("ci_high"))


@add("STAT5", f"WITH {_NATIONS} SELECT k, CASE WHEN ci_low >= -4500 AND ci_high <= 4500 THEN 'equivalent' WHEN ci_low > 4500 OR ci_high < -4500 THEN 'beyond_margin' WHEN ci_low > 0 OR ci_high < 0 THEN 'directional' ELSE 'inconclusive' END verdict FROM n")
def _(s, d):
    return _nations(s, d).select("k", x.verdict(F.col("ci_low"), F.col("ci_high"), F.lit(4500)).alias("verdict"))


@add("AGG24", f"WITH {_NATIONS} SELECT count(*) n_seeds, min(n_pairs) min_pairs, max(n_pairs) max_pairs, round(min(mean), 4) min_mean, round(median(mean), 4) median_mean, round(max(mean), 4) max_mean, bool_and(mean > 0) all_positive, round(avg(CAST(ci_low > 0 OR ci_high < 0 AS INTEGER)), 6) share_excluding_zero FROM n")
def _(s, d):
    return inf.sweep_summary(_nations(s, d)).select("n_seeds", "min_pairs", "max_pairs", *(F.round(c, 4).alias(c) for c in ("min_mean", "median_mean", "max_mean")), "all_positive", r6("share_excluding_zero"))


@add("AGG25", "SELECT round(median(g), 6) median_gap, round(quantile_cont(g, 0.95), 6) p95_gap, round(corr(l_discount, l_tax), 6) correlation FROM (SELECT abs(l_discount - l_tax) / 0.02 g, l_discount, l_tax FROM lineitem)")
def _(s, d):
    return inf.convergence(an.table(s, d, "lineitem"), "l_discount", "l_tax", F.lit(0.02)).select(r6("median_gap"), r6("p95_gap"), r6("correlation"))


@add("AGG27", """WITH q AS (SELECT quantile_cont(c_acctbal, [0, 0.2, 0.4, 0.6, 0.8, 1]) q FROM customer), b AS (SELECT greatest(len(list_filter(list_distinct(q), lambda e: e < c_acctbal)), 1) - 1 bin, c_acctbal, c_custkey FROM customer, q)
SELECT CAST(bin AS INTEGER) bin, count(*) n, round(avg(c_acctbal), 4) mean_c_acctbal, round(avg(c_custkey), 4) mean_c_custkey FROM b GROUP BY 1""")
def _(s, d):
    return inf.quintiles(an.table(s, d, "customer"), "c_acctbal", "c_custkey").select("bin", "n", F.round("mean_c_acctbal", 4).alias("mean_c_acctbal"), F.round("mean_c_custkey", 4).alias("mean_c_custkey"))


@add("AGG30", "SELECT p_type, round(quantile_cont(p_retailprice, 0.25), 6) q1, round(median(p_retailprice), 6) q2, round(quantile_cont(p_retailprice, 0.75), 6) q3 FROM part GROUP BY 1")
def _(s, d):
    return inf.box_stats(an.table(s, d, "part"), "p_type", "p_retailprice").select("p_type", r6("q1"), r6("q2"), r6("q3"))


_PICK = "CAST(('0x' || substr(md5('{salt}-' || {draw} || '-' || {slot}), 1, 8)) AS BIGINT) % {n}"
_UNITS = "units AS (SELECT row_number() OVER (ORDER BY c_nationkey) - 1 unit_at, sum(c_acctbal) s, count(*) n FROM customer GROUP BY c_nationkey)"
_DRAWS = f"{_UNITS}, draws AS (SELECT draw, sum(s) / sum(n) mean FROM (SELECT draw, {_PICK.format(salt='b', draw='draw', slot='slot', n='(SELECT count(*) FROM units)')} unit_at FROM (SELECT unnest(range(300)) draw), (SELECT unit_at slot FROM units)) JOIN units USING (unit_at) GROUP BY 1)"


@add("STAT1", f"WITH {_DRAWS} SELECT draw, round(mean, 6) mean FROM draws")
def _(s, d):
    return inf.bootstrap_draws(an.table(s, d, "customer"), "c_nationkey", "c_acctbal", 300).select("draw", r6("mean"))


@add("STAT4", f"WITH {_DRAWS} SELECT round(quantile_cont(mean, 0.025), 4) ci_low, round(quantile_cont(mean, 0.975), 4) ci_high FROM draws")
def _(s, d):
    return inf.interval(inf.bootstrap_draws(an.table(s, d, "customer"), "c_nationkey", "c_acctbal", 300)).select(F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"))


@add("STAT2", f"WITH units AS (SELECT row_number() OVER (ORDER BY accession) - 1 unit_at, s, n FROM (SELECT CAST(l_suppkey AS VARCHAR) accession, sum(l_discount) s, count(*) n FROM lineitem GROUP BY 1)), draws AS (SELECT draw, sum(s) / sum(n) mean FROM (SELECT draw, {_PICK.format(salt='protein', draw='draw', slot='slot', n='(SELECT count(*) FROM units)')} unit_at FROM (SELECT unnest(range(80)) draw), (SELECT unit_at slot FROM units)) JOIN units USING (unit_at) GROUP BY 1) SELECT draw, round(mean, 6) mean FROM draws")
def _(s, d):
    rows = an.table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("accession"), "l_discount")
    return inf.bootstrap_draws(rows, "accession", "l_discount", 80, "protein").select("draw", r6("mean"))


@add("STAT7", f"""WITH {_UNITS.replace('c_acctbal', '(c_acctbal - 4500)')}, d AS (SELECT draw, sum(s * CASE WHEN {_PICK.format(salt='p', draw='draw', slot='unit_at', n='2')} = 1 THEN 1 ELSE -1 END) / sum(n) m FROM (SELECT unnest(range(500)) draw), units GROUP BY 1),
o AS (SELECT count(*) n_units, sum(s) / sum(n) observed FROM units) SELECT n_units, round(observed, 4) observed, round((count(*) FILTER (abs(m) >= abs(observed) - 1e-15) + 1) / 501.0, 6) p FROM d, o GROUP BY 1, observed""")
def _(s, d):
    rows = an.table(s, d, "customer").select("c_nationkey", (F.col("c_acctbal") - 4500).alias("v"))
    return inf.sign_flips(rows, "c_nationkey", "v", 500).select("n_units", F.round("observed", 4).alias("observed"), r6("p"))


_TESTS = "t AS (SELECT CAST(n_nationkey AS VARCHAR) test, (n_nationkey * 7 % 25 + 1) / 200.0 p FROM nation), k AS (SELECT *, row_number() OVER (ORDER BY p, test) i, count(*) OVER () m FROM t)"


@add("STAT8", f"WITH {_TESTS} SELECT test, round(least(1.0, max((m - i + 1) * p) OVER (ORDER BY p, test)), 6) p_holm, round(least(1.0, min(m * p / i) OVER (ORDER BY p DESC, test DESC)), 6) p_bh FROM k")
def _(s, d):
    tests = an.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("test"), ((F.col("n_nationkey") * 7 % 25 + 1) / 200.0).alias("p"))
    return inf.adjusted(tests).select("test", r6("p_holm"), r6("p_bh"))


@add("STAT12", "SELECT count(*) n, round(corr(a, b), 6) rho FROM (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 a, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 b FROM customer)")
def _(s, d):
    return inf.spearman(an.table(s, d, "customer").select("c_acctbal", "c_nationkey"), "c_acctbal", "c_nationkey").select("n", r6("rho"))


def _sensitive(label: str, test: str) -> str:
    return f"""u_{label} AS (SELECT row_number() OVER (ORDER BY c_nationkey) - 1 unit_at, sum(c_acctbal) s, count(*) n FROM customer WHERE {test} GROUP BY c_nationkey),
  d_{label} AS (SELECT draw, sum(s) / sum(n) mean FROM (SELECT draw, {_PICK.format(salt=label, draw='draw', slot='slot', n=f'(SELECT count(*) FROM u_{label})')} unit_at FROM (SELECT unnest(range(100)) draw), (SELECT unit_at slot FROM u_{label})) JOIN u_{label} USING (unit_at) GROUP BY 1),
  r_{label} AS (SELECT '{label}' AS label, (SELECT count(*) FROM customer WHERE {test}) n, (SELECT avg(c_acctbal) FROM customer WHERE {test}) mean, quantile_cont(mean, 0.025) ci_low, quantile_cont(mean, 0.975) ci_high FROM d_{label})"""


@add("STAT18", f"""WITH {_sensitive('all', 'true')}, {_sensitive('unflagged', "c_mktsegment <> 'BUILDING'")} SELECT label, n, round(mean, 4) mean, round(ci_low, 4) ci_low, round(ci_high, 4) ci_high,
CASE WHEN ci_low >= -4500 AND ci_high <= 4500 THEN 'equivalent' WHEN ci_low > 4500 OR ci_high < -4500 THEN 'beyond_margin' WHEN ci_low > 0 OR ci_high < 0 THEN 'directional' ELSE 'inconclusive' END verdict FROM (FROM r_all UNION ALL FROM r_unflagged)""")
def _(s, d):
    rows = an.table(s, d, "customer")
    out = inf.sensitivity({"all": rows, "unflagged": rows.where("c_mktsegment <> 'BUILDING'")}, "c_nationkey", "c_acctbal", 100, 4500.0)
    return out.select("label", "n", *(F.round(c, 4).alias(c) for c in ("mean", "ci_low", "ci_high")), "verdict")


@add("STAT16", "SELECT p_partkey FROM part ORDER BY md5('3-' || p_partkey), p_partkey LIMIT 50")
def _(s, d):
    return inf.seeded_sample(an.table(s, d, "part"), ["p_partkey"], 50, 3).select("p_partkey")


# -- structures and scores ------------------------------------------------------------------------


@add("FN28", f"WITH {an.VECTORS}, q AS (SELECT vec_id, least(greatest(p[12], 1e-6), 1 - 1e-6) n, least(greatest(p[16] + p[17], 1e-6), 1 - 1e-6) st FROM vectors) SELECT vec_id, round((ln(n / (1 - n)) + ln(st / (1 - st))) / 2, 6) score FROM q")
def _(s, d):
    return an.vectors(s, d).select("vec_id", F.round(x.sequon_score(F.col("p"), F.col("p")), 6).alias("score"))


@add("FN29", "SELECT vec_id, embedding[1] > 0 AND embedding[2] > 0 AND embedding[3] > 0 scoreable FROM embeddings")
def _(s, d):
    mask = F.transform("embedding", lambda e: e > 0)
    return an.table(s, d, "embeddings").select("vec_id", x.scoreable(mask, F.array(F.lit(0), F.lit(1), F.lit(2))).alias("scoreable"))


@add("AGG31", f"WITH {an.VECTORS}, q AS (SELECT label, least(greatest(p[12], 1e-6), 1 - 1e-6) n, least(greatest(p[16] + p[17], 1e-6), 1 - 1e-6) st FROM vectors) SELECT label AS key, round(avg((ln(n / (1 - n)) + ln(st / (1 - st))) / 2), 6) score, round(coalesce(stddev_samp((ln(n / (1 - n)) + ln(st / (1 - st))) / 2), 0), 6) score_sd, count(*) n_orders FROM q GROUP BY 1")
def _(s, d):
    rows = an.vectors(s, d).select(F.col("label").alias("key"), F.lit(0).alias("order"), F.col("p").alias("at_n"), F.col("p").alias("at_plus2"))
    return sc.order_scores(rows, 1).select("key", r6("score"), r6("score_sd"), "n_orders")


@add("AGG26", """WITH w AS (SELECT doc_id, list_filter(string_split(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' '), lambda t: length(t) > 2) w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) n_designs_scored, CAST(len(list_filter(w, lambda t: t[1] = 'N' AND t[3] IN ('S','T') AND t[2] <> 'P')) AS INTEGER) n_full, CAST(len(list_filter(w, lambda t: t[1] <> 'N' AND t[3] NOT IN ('S','T'))) AS INTEGER) n_lost FROM w""")
def _(s, d):
    words = F.split(F.upper(F.regexp_replace("text", "[^A-Za-z ]", "")), " ")
    rows = an.table(s, d, "documents").select("doc_id", words.alias("w"))
    out = rows.select("doc_id", x.retention(F.col("w"), F.lit(0), F.lit(1), F.lit(2)).alias("r"))
    return out.select("doc_id", "r.n_designs_scored", F.col("r.n_full_sequon_retained").alias("n_full"), F.col("r.n_complete_motif_loss").alias("n_lost"))


@add("FN33", "SELECT p_partkey, CAST(greatest(1, least(32, 6000 // greatest(p_size, 1))) AS BIGINT) batch FROM part")
def _(s, d):
    return an.table(s, d, "part").select("p_partkey", x.batch_size(F.col("p_size"), F.lit(32)).cast("long").alias("batch"))


@add("FN30", "SELECT p_partkey, left(p_name, 70) reason FROM part")
def _(s, d):
    return an.table(s, d, "part").select("p_partkey", x.normal_reason(F.concat("p_name", F.lit("_["), F.col("p_size").cast("string"), F.lit("]"))).alias("reason"))


@add("UDF9", "SELECT i AS index, coalesce(sum(l_quantity), 0) AS sum, round(coalesce(avg(l_quantity), 0), 6) mean, coalesce(min(l_quantity), 0) AS min, coalesce(max(l_quantity), 0) AS max FROM (SELECT unnest(range(10)) i) LEFT JOIN lineitem ON l_linenumber = i GROUP BY 1")
def _(s, d):
    rows = an.table(s, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("index"), F.col("l_quantity").alias("src"))
    return sc.segment_reduce(rows, 10).select("index", "sum", r6("mean"), "min", "max")


_ODDS = "ln(greatest(least({p}, 1 - 1e-6), 1e-6) / (1 - greatest(least({p}, 1 - 1e-6), 1e-6)))"
_HASHED = f"""{_MOTIFS}, h AS (SELECT accession, position, o, k, sha256('0-' || o || '-' || (position - 1 + k) || '-' || sequence[greatest(position + k - 3, 1):position + k + 3]) hex FROM motifs, (SELECT unnest([0, 1]) o), (SELECT unnest([0, 2]) k)),
w AS (SELECT accession, position, o, k, list_transform(range(21), lambda i: CAST('0x' || substr(hex, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) + 1.0) w FROM h),
q AS (SELECT accession, position, o, max(w[12] / list_sum(w)) FILTER (k = 0) n, max((w[16] + w[17]) / list_sum(w)) FILTER (k = 2) st FROM w GROUP BY 1, 2, 3)"""


def _chains(s: SparkSession, d: str) -> DataFrame:
    return an.proteins(s, d).where(F.length("sequence") >= 3).select(F.col("accession").alias("structure_pdb_id"), F.lit("A").alias("structure_chain_id"), "sequence")


def _scored_sites(s: SparkSession, d: str) -> DataFrame:
    sites = x.sequon_sites(an.proteins(s, d))
    return sites.select("accession", "position", F.col("accession").alias("structure_pdb_id"), F.lit("A").alias("structure_chain_id"), "sequon", *((F.col("position") - 1 + i).alias(f"{n}_model_index") for i, n in enumerate(("n", "plus1", "plus2"))))


@add("UDF1", f"WITH {_HASHED} SELECT accession, position, round(avg(({_ODDS.format(p='n')} + {_ODDS.format(p='st')}) / 2), 6) score, CAST(NULL AS VARCHAR) error, 'hash' model, 2 n_orders FROM q GROUP BY 1, 2")
def _(s, d):
    return sc.score_chains(_scored_sites(s, d), _chains(s, d), "hash", n_orders=2).select("accession", "position", F.round("conditional_sequon_score", 6).alias("score"), "error", "model", "n_orders")


# -- single functions and further joins -----------------------------------------------------------

_TEXT = "f AS (SELECT accession, position, glyco_type, code, parse_status FROM features)"


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return x.parse_features(an.annotations(s, d))


@add("FN1", f"WITH {an.FEATURES} SELECT accession, list_distinct(list(code)) codes FROM features WHERE code IS NOT NULL GROUP BY 1")
def _(s, d):
    return an.annotations(s, d).select("accession", x.eco_codes(F.col("Glycosylation")).alias("codes"))


@add("FN2", f"WITH {an.FEATURES} SELECT accession, CAST(count(*) AS INTEGER) n_pieces FROM features GROUP BY 1")
def _(s, d):
    return an.annotations(s, d).select("accession", F.size(x.feature_pieces(F.col("Glycosylation"))).alias("n_pieces"))


@add("FN3", f"WITH {an.FEATURES} SELECT parse_status, count(*) n, count(position) n_positions FROM features GROUP BY 1")
def _(s, d):
    return _parsed(s, d).groupBy("parse_status").agg(F.count("*").alias("n"), F.count("position").alias("n_positions"))


@add("FN4", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'O-linked (GalNAc...) serine' WHEN 'LARGE' THEN 'N-linked (Glc) (glycation) lysine' ELSE 'N-linked (GlcNAc...) asparagine' END note, count(*) n FROM part GROUP BY 1")
def _(s, d):
    return _parsed(s, d).where("parse_status = 'ok'").groupBy(F.col("raw_note").alias("note")).agg(F.count("*").alias("n"))


@add("FN5", f"WITH {an.FEATURES} SELECT glyco_type, count(*) n FROM features GROUP BY 1")
def _(s, d):
    return _parsed(s, d).groupBy("glyco_type").agg(F.count("*").alias("n"))


@add("FN7", f"WITH {an.FEATURES} SELECT {an.TIER} tier, count(*) n FROM features GROUP BY 1")
def _(s, d):
    return _parsed(s, d).groupBy(x.annotation_tier(F.col("evidence_codes")).alias("tier")).agg(F.count("*").alias("n"))


@add("FN8", f"WITH {_LAYER} SELECT exclusion_reason, count(*) n FROM annotated GROUP BY 1")
def _(s, d):
    return _annotated(s, d).groupBy("exclusion_reason").agg(F.count("*").alias("n"))


@add("FN9", f"WITH {an.ENTRIES} SELECT {an.GLYCAN_TIERS}[rank + 1] tier, count(*) n FROM entries GROUP BY 1, rank")
def _(s, d):
    return an.glycan_entries(s, d).groupBy(x.glycan_entry_tier(F.col("categories"), F.transform("evidence", lambda e: e["database"])).alias("tier")).agg(F.count("*").alias("n"))


@add("FN10", "SELECT event_type, count(*) FILTER (event_type <> 'error') n_usable FROM events GROUP BY 1")
def _(s, d):
    rows = an.table(s, d, "events").select("event_type", F.when(F.col("event_type") == "error", "O-linked").otherwise("N-Linked").alias("kind"), F.lit(3).alias("a"))
    return rows.groupBy("event_type").agg(F.count_if(x.glycan_entry_usable(F.col("kind"), F.col("a"), F.col("a"))).alias("n_usable"))


@add("FN11", f"WITH {an.ENTRIES} SELECT count(*) FILTER (db = 'PubMed') n_ids FROM entries")
def _(s, d):
    return an.glycan_entries(s, d).agg(F.sum(F.size(x.ids_by_database(F.col("evidence"), "PubMed"))).alias("n_ids"))


@add("FN12", "SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE -1 END AS position FROM events")
def _(s, d):
    label = F.concat(F.when(F.col("event_type") == "view", "Ser-").otherwise(" ASN-"), F.get_json_object("props", "$.k"))
    return an.table(s, d, "events").select("event_id", F.coalesce(x.site_label_position(label), F.lit(-1)).alias("position"))


@add("FN13", f"WITH {_COMBINED} SELECT support_sources, support_count, count(*) n FROM combined GROUP BY 1, 2")
def _(s, d):
    return _combined(s, d).groupBy("support_sources", "support_count").agg(F.count("*").alias("n"))


@add("FN14", f"WITH {_COMBINED} SELECT occupancy_status, count(*) n FROM combined GROUP BY 1")
def _(s, d):
    return _combined(s, d).groupBy("occupancy_status").agg(F.count("*").alias("n"))


@add("FN17", "SELECT doc_id, [lang, source] ids FROM documents")
def _(s, d):
    return an.table(s, d, "documents").select("doc_id", x.clean_ids(F.concat(F.lit(" "), F.col("lang"), F.lit(" ;; "), F.col("source"), F.lit(";"))).alias("ids"))


@add("FN18", "SELECT c_custkey, c_mktsegment = 'MACHINERY' competent FROM customer")
def _(s, d):
    host = F.when(F.col("c_mktsegment") == "MACHINERY", "Homo sapiens (hek293)").otherwise("Escherichia coli")
    return an.table(s, d, "customer").select("c_custkey", x.competent_host(host).alias("competent"))


@add("FN19", "SELECT l_orderkey, l_partkey, round(least(l_quantity / 187, 1.5), 6) rsa, CASE WHEN least(l_quantity / 187, 1.5) < 0.09 THEN 'buried' WHEN least(l_quantity / 187, 1.5) < 0.36 THEN 'intermediate' ELSE 'exposed' END bin FROM lineitem")
def _(s, d):
    value = x.rsa(F.col("l_quantity"), F.lit("N"))
    return an.table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.round(value, 6).alias("rsa"), x.rsa_bin(value).alias("bin"))


@add("FN22", "SELECT l_returnflag, CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag END code, count(*) n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    raw = F.when(F.col("l_returnflag") == "N", "None").otherwise(F.concat(F.lit(" "), F.col("l_returnflag")))
    return an.table(s, d, "lineitem").groupBy("l_returnflag", x.clean_icode(raw).alias("code")).agg(F.count("*").alias("n"))


@add("FN26", "SELECT l_discount, round(ln(greatest(least(l_discount, 1 - 1e-6), 1e-6) / (1 - greatest(least(l_discount, 1 - 1e-6), 1e-6))), 6) odds, count(*) n FROM lineitem GROUP BY 1")
def _(s, d):
    return an.table(s, d, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n")).select("l_discount", F.round(x.logit(F.col("l_discount")), 6).alias("odds"), "n")


@add("FN27", f"WITH {an.VECTORS}, v AS (SELECT vec_id, CASE WHEN label = 0 THEN list_transform(p, lambda q: q * 2) ELSE p END p FROM vectors) SELECT vec_id, abs(list_sum(p) - 1) <= 1e-3 AND list_min(p) >= 0 AND list_max(p) <= 1.001 valid FROM v")
def _(s, d):
    rows = an.vectors(s, d).withColumn("p", F.when(F.col("label") == 0, F.transform("p", lambda q: q * 2)).otherwise(F.col("p")))
    return rows.select("vec_id", x.is_distribution(F.col("p")).alias("valid"))


@add("FN36", f"WITH {_MOTIFS} SELECT sequence[position:position + 2] triplet, true is_sequon, count(*) n FROM motifs GROUP BY 1")
def _(s, d):
    return x.sequon_sites(an.proteins(s, d)).groupBy(F.col("sequon").alias("triplet"), x.is_sequon(F.col("sequon")).alias("is_sequon")).agg(F.count("*").alias("n"))


@add("JN3", f"WITH {an.ASSOCIATED}, s AS (SELECT accession, position, bool_or(homology_qc_bucket = 'strict') in_strict FROM associated GROUP BY 1, 2), p AS (SELECT CAST(p_partkey AS VARCHAR) accession, 1 AS position FROM part) SELECT accession, position, coalesce(in_strict, false) in_strict FROM p LEFT JOIN s USING (accession, position)")
def _(s, d):
    base = an.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("accession"), F.lit(1).alias("position"))
    return st.joined_layers(base, [st.subsets(_links(s, d))]).select("accession", "position", F.coalesce("in_strict", F.lit(False)).alias("in_strict"))


@add("JN8", "SELECT CAST(p_partkey AS VARCHAR) accession, 1 AS position, round(score, 7) score FROM part JOIN (SELECT l_partkey, avg(l_extendedprice) score FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def _(s, d):
    manifest = an.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("accession"), F.lit(1).alias("position"))
    return inf.with_scores(manifest, an.scores(s, d), ["accession", "position"]).withColumn("score", F.round("score", 7))


@add("JN10", f"WITH {an.NEAREST}, k AS (SELECT DISTINCT case_accession FROM nearest) SELECT CAST(p_partkey AS VARCHAR) accession, p_brand brand FROM part JOIN k ON case_accession = CAST(p_partkey AS VARCHAR)")
def _(s, d):
    keys = _edges(s, d).select(F.col("case_accession").alias("accession")).distinct()
    return an.side(s, d, "PROMO").join(keys, "accession").select("accession", "brand")


@add("JN18", "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def _(s, d):
    return st.one_to_one(an.table(s, d, "labels"), an.table(s, d, "documents"), ["doc_id"]).select("doc_id", "quality", "lang")


@add("JN19", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(s, d):
    return st.not_in_keys(an.table(s, d, "customer").select("c_custkey"), an.table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@add("JN20", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def _(s, d):
    keys = an.table(s, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return st.in_keys(an.table(s, d, "supplier").select("s_suppkey", "s_nationkey"), keys, ["s_nationkey"]).select("s_suppkey")


@add("AGG13", "SELECT round((avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag <> 'A')) / sqrt((var_samp(l_quantity) FILTER (l_returnflag = 'A') + var_samp(l_quantity) FILTER (l_returnflag <> 'A')) / 2), 6) smd FROM lineitem")
def _(s, d):
    rows = an.table(s, d, "lineitem").select((F.col("l_returnflag") == "A").alias("is_case"), "l_quantity")
    return ma.balance(rows, ["l_quantity"]).select(r6("smd"))


@add("AGG15", "WITH m AS (SELECT l_linestatus = 'O' c, sum(l_quantity * l_discount) / sum(l_quantity) m FROM lineitem GROUP BY 1) SELECT round(max(m) FILTER (c), 6) case_mean, round(max(m) FILTER (NOT c), 6) control_mean FROM m")
def _(s, d):
    rows = an.table(s, d, "lineitem").select((F.col("l_linestatus") == "O").alias("is_case"), "l_quantity", "l_discount")
    return ma.balance(rows, ["l_discount"], weight="l_quantity").select(r6("case_mean"), r6("control_mean"))


@add("SRT2", f"WITH {an.SITES} SELECT accession, position, pair_id FROM links ORDER BY 1, 2, 3")
def _(s, d):
    return st.positioned(st.ready(an.pairs(s, d))).select("accession", "position", "pair_id").orderBy("accession", "position", "pair_id")


@add("SRT4", "SELECT reason, count(*) AS count FROM (SELECT p_type reason FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return sk.top_reasons(an.table(s, d, "part").select(F.concat("p_type", F.lit("_[1, 2]")).alias("reason")))


@add("SET2", "SELECT doc_id, len(list_intersect(string_split(lang || ';' || source, ';'), ['en', 'src0'])) > 0 AS shared FROM documents")
def _(s, d):
    return an.table(s, d, "documents").select("doc_id", F.arrays_overlap(x.clean_ids(F.concat_ws(";", "lang", "source")), F.array(F.lit("en"), F.lit("src0"))).alias("shared"))


@add("STAT3", f"WITH units AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 unit_at, s_acctbal s, 1 n FROM supplier), draws AS (SELECT draw, sum(s) / sum(n) mean FROM (SELECT draw, {_PICK.format(salt='r', draw='draw', slot='slot', n='(SELECT count(*) FROM units)')} unit_at FROM (SELECT unnest(range(50)) draw), (SELECT unit_at slot FROM units)) JOIN units USING (unit_at) GROUP BY 1) SELECT draw, round(mean, 6) mean FROM draws")
def _(s, d):
    return inf.bootstrap_draws(an.table(s, d, "supplier"), "s_suppkey", "s_acctbal", 50, "r").select("draw", r6("mean"))


@add("STAT9", f"WITH {_TESTS} SELECT test, round(least(1.0, min(m * p / i) OVER (ORDER BY p DESC, test DESC)), 6) p_bh FROM k")
def _(s, d):
    tests = an.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("test"), ((F.col("n_nationkey") * 7 % 25 + 1) / 200.0).alias("p"))
    return inf.adjusted(tests).select("test", r6("p_bh"))


_GAPS = "SELECT '{kind}' kind, median(abs({a} - {b}) / {sd}) < 0.02 AND quantile_cont(abs({a} - {b}) / {sd}, 0.95) < 0.05 AND corr({a}, {b}) > 0.99 adopt FROM lineitem"


@add("STAT17", _GAPS.format(kind="apart", a="l_discount", b="l_tax", sd="0.02") + " UNION ALL " + _GAPS.format(kind="near", a="l_extendedprice", b="round(l_extendedprice, -2)", sd="20000") + " UNION ALL " + _GAPS.format(kind="coarse", a="l_extendedprice", b="round(l_extendedprice, -4)", sd="20000"))
def _(s, d):
    """A cheaper score that is adopted, one whose gaps are too wide, and one that has nothing to do with the other."""
    rows = an.table(s, d, "lineitem").withColumns({"hundreds": F.round("l_extendedprice", -2), "thousands": F.round("l_extendedprice", -4)})
    made = [inf.convergence(rows, a, b, F.lit(sd)).select(F.lit(kind).alias("kind"), "adopt") for kind, a, b, sd in (("apart", "l_discount", "l_tax", 0.02), ("near", "l_extendedprice", "hundreds", 20000.0), ("coarse", "l_extendedprice", "thousands", 20000.0))]
    return made[0].unionAll(made[1]).unionAll(made[2])


@add("DDP2", "SELECT p_name, min(p_partkey) p_partkey FROM part GROUP BY 1")
def _(s, d):
    return st.keep_first(an.table(s, d, "part").select("p_name", "p_partkey"), ["p_name"], ["p_partkey"])


@add("DDP4", "SELECT l_partkey, l_suppkey, l_linenumber, l_returnflag, max(l_extendedprice) price FROM lineitem GROUP BY 1, 2, 3, 4")
def _(s, d):
    rows = an.table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("price"))
    return st.keep_first(rows, ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"], [-F.col("price")])


@add("DQ2", "SELECT count(*) n_rows, count(*) FILTER (o_orderstatus <> 'F') n_disagree FROM orders")
def _(s, d):
    return ck.disagreements(an.table(s, d, "orders"), F.concat(F.lit("control_"), "o_orderstatus"), F.lit("control_F"))


@add("DQ3", f"WITH {an.NEAR} SELECT count(*) n_foreign FROM near WHERE control_accession NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'ECONOMY' AND p_size > 5)")
def _(s, d):
    return ck.foreign(_edges(s, d), an.side(s, d, "ECONOMY").where("size > 5").select(F.col("accession").alias("control_accession")), ["control_accession"])


@add("DQ5", f"WITH {_COMBINED} SELECT count(*) n_positive_controls FROM combined WHERE experimental_positive AND accession IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'ECONOMY')")
def _(s, d):
    return _combined(s, d).where("experimental_positive").join(an.side(s, d, "ECONOMY").select("accession"), "accession", "left_semi").agg(F.count("*").alias("n_positive_controls"))


@add("DQ8", f"WITH {_COMBINED} SELECT count(*) n_input, count(*) FILTER (experimental_positive) + count(*) FILTER (NOT experimental_positive) n_parts FROM combined")
def _(s, d):
    return sk.partition_counts(_combined(s, d), {"positive": F.col("experimental_positive"), "excluded": ~F.col("experimental_positive")})


@add("SNK7", "SELECT DISTINCT upper(p_brand) pdb_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def _(s, d):
    key = lambda c: F.col(c).cast("string").alias("accession")
    need = an.table(s, d, "lineitem").select(key("l_partkey"), F.lit(1).alias("position")).distinct()
    return sk.bundle_ids([need, need], an.table(s, d, "part").select(key("p_partkey"), F.lit(1).alias("position"), F.col("p_brand").alias("structure_pdb_id")))


_UNITED = f"""{_CONTRASTS}, e AS (SELECT case_accession a, unnest(string_split(control_proteins, ';')) b FROM contrasts),
reach AS (SELECT DISTINCT a, a z FROM e UNION SELECT r.a, f.a FROM reach r JOIN e ON e.a = r.z JOIN e f ON f.b = e.b),
u AS (SELECT a case_accession, min('cluster:solo:' || z) u FROM reach GROUP BY 1),
units AS (SELECT row_number() OVER (ORDER BY u) - 1 unit_at, sum(case_score - control_mean_score) s, count(*) n FROM contrasts JOIN u USING (case_accession) GROUP BY u),
draws AS (SELECT draw, sum(s) / sum(n) mean FROM (SELECT draw, {_PICK.format(salt='b', draw='draw', slot='slot', n='(SELECT count(*) FROM units)')} unit_at FROM (SELECT unnest(range(200)) draw), (SELECT unit_at slot FROM units)) JOIN units USING (unit_at) GROUP BY 1),
ends AS (SELECT quantile_cont(mean, 0.025) ci_low, quantile_cont(mean, 0.975) ci_high, (SELECT 0.2 * stddev_samp(score) FROM scores) m FROM draws)"""


_ONE = f"""{_UNITED}, v AS (SELECT case_score - control_mean_score c, case_accession FROM contrasts), o AS (SELECT c, row_number() OVER (ORDER BY c) i, count(*) OVER () n, sum(c) OVER () t FROM v),
l AS (SELECT max(n) n, avg(c) mean, median(c) median, avg(c) FILTER (i > floor(n * 0.1) AND i <= n - floor(n * 0.1)) trimmed_mean, count(*) FILTER (c > 0) n_positive, (max(t) - max(c)) / (max(n) - 1) loo_min, (max(t) - min(c)) / (max(n) - 1) loo_max FROM o)"""
_PARTS = [
    "SELECT 'contrast' part, case_accession AS name, round(c, 4) AS value, u AS label FROM v JOIN u USING (case_accession)",
    "SELECT 'interval', 'low', round(ci_low, 3), CASE WHEN ci_low >= -m AND ci_high <= m THEN 'equivalent' WHEN ci_low > m OR ci_high < -m THEN 'beyond_margin' WHEN ci_low > 0 OR ci_high < 0 THEN 'directional' ELSE 'inconclusive' END FROM ends",
    "SELECT 'interval', 'high', round(ci_high, 3), '' FROM ends",
    *(f"SELECT 'location', '{c}', round({c}, 3), '' FROM l" for c in ("n", "mean", "median", "trimmed_mean", "n_positive", "loo_min", "loo_max")),
    "SELECT 'reuse', 'most', CAST(max(k) AS DOUBLE), '' FROM (SELECT count(*) k FROM e GROUP BY b)",
    "SELECT 'subtype', p_brand, round(avg(c), 3), CAST(count(*) AS VARCHAR) FROM v JOIN part ON case_accession = CAST(p_partkey AS VARCHAR) GROUP BY 2",
]


@add("CMP10", f"WITH RECURSIVE {_ONE} " + " UNION ALL ".join(_PARTS))
def _(s, d):
    """Every output of the primary analysis: contrasts with their units, interval and verdict, location, reuse, subtypes."""
    kinds = an.side(s, d, "PROMO").select("accession", "position", F.col("brand").alias("subtype"))
    made = runs.primary(_nearest(s, d), an.scores(s, d), None, 200, subtypes=kinds)
    row = lambda rows, part, name, value, digits, label="": rows.select(F.lit(part).alias("part"), name.alias("name"), rounded(value, digits).alias("value"), (label if isinstance(label, Column) else F.lit(label)).alias("label"))
    parts = [row(made["contrasts"], "contrast", F.col("case_accession"), "contrast", 4, F.col("resample_unit"))]
    parts += [row(made["verdict"], "interval", F.lit("low"), "ci_low", 3, F.col("verdict")), row(made["verdict"], "interval", F.lit("high"), "ci_high", 3)]
    parts += [row(made["location"], "location", F.lit(c), c, 3) for c in ("n", "mean", "median", "trimmed_mean", "n_positive", "loo_min", "loo_max")]
    parts += [row(made["control_reuse"], "reuse", F.lit("most"), "most_used_control", 3), row(made["subtypes"], "subtype", F.col("subtype"), "mean", 3, F.col("n").cast("string"))]
    return reduce(DataFrame.unionAll, parts)


# -- filters, joins and statistics on their own -----------------------------------------------------


@add("FLT6", f"WITH {_LAYER} SELECT accession, position, uniprot_tier IN ('manual_experimental','manual_curator_inference') chosen FROM annotated")
def _(s, d):
    return _annotated(s, d).select("accession", "position", ev.chosen("uniprot_tier", ("manual_experimental", "manual_curator_inference")).alias("chosen"))


_SPLIT = f"{_COMBINED}, flagged AS (SELECT c.*, a.uniprot_tier, c.position < 10 in_strict, c.position < 25 in_strict_plus_plausible FROM combined c JOIN annotated a USING (accession, position))"


@add("FLT7", f"""WITH {_SPLIT} SELECT 'all' part, count(*) n FROM flagged WHERE experimental_positive UNION ALL SELECT 'strict', count(*) FROM flagged WHERE experimental_positive AND in_strict
UNION ALL SELECT 'strict_plus_plausible', count(*) FROM flagged WHERE experimental_positive AND in_strict_plus_plausible UNION ALL SELECT 'excluded', count(*) FROM flagged WHERE NOT experimental_positive UNION ALL SELECT 'curator', count(*) FROM flagged WHERE uniprot_tier = 'manual_curator_inference'""")
def _(s, d):
    rows = _combined(s, d).withColumn("in_strict", F.col("position") < 10).withColumn("in_strict_plus_plausible", F.col("position") < 25)
    return st.stacked([part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, part in st.splits(rows).items()])


@add("FLT8", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 0")
def _(s, d):
    rows = an.table(s, d, "documents").join(an.table(s, d, "labels"), "doc_id", "left").select("doc_id", (F.col("toxic") == 0).alias("scoreable"))
    return st.scoreable_only(rows).select("doc_id")


@add("FLT9", "SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY')")
def _(s, d):
    return st.of_class(an.table(s, d, "part"), "PROMO", "ECONOMY", column="p_type").select("p_partkey")


@add("FLT11", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    return st.present(an.table(s, d, "region"), ("r_regionkey", "r_comment", "r_name"))


@add("DDP3", "SELECT source, doc_id, min(n_chars) n_chars FROM documents GROUP BY 1, 2")
def _(s, d):
    rows = an.table(s, d, "documents").select("source", "doc_id", "n_chars")
    return st.keep_first(rows.unionAll(rows.withColumn("n_chars", F.col("n_chars") + 1)), ["source", "doc_id"], ["n_chars"])


@add("DDP5", "SELECT l_partkey, l_suppkey, min(l_linenumber) l_linenumber FROM lineitem GROUP BY 1, 2")
def _(s, d):
    four = ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    rows = st.keep_first(an.table(s, d, "lineitem").select(*four), four, ["l_partkey"])
    return st.keep_first(rows, four[:2], ["l_linenumber", "l_returnflag"]).select(*four[:3])


@add("JN4", f"WITH {_GLYCAN}, {_USERS}, comp AS (SELECT CAST(user_id AS VARCHAR) accession, CAST(json_extract_string(props, '$.k') AS INTEGER) AS position, count(*) n FROM events GROUP BY 1, 2) SELECT accession, position, coalesce(glygen_tier, '') glygen_tier, coalesce(n, 0) glyconnect_glycan_count, n IS NOT NULL glyconnect_supported FROM users LEFT JOIN glycan USING (accession, position) LEFT JOIN comp USING (accession, position)")
def _(s, d):
    sites = _user_sites(s, d)
    rows = an.table(s, d, "events").select(F.col("user_id").cast("string").alias("accession"), F.col("event_type").alias("composition_string"), F.array(F.struct(F.concat(F.lit("Asn-"), F.get_json_object("props", "$.k")).alias("site"))).alias("sites"))
    layers = [ev.layer_on_sites(sites, ev.glycan_sites(an.glycan_entries(s, d))), ev.layer_on_sites(sites, ev.composition_sites(rows))]
    return st.joined_layers(sites, layers).select("accession", "position", "glygen_tier", "glyconnect_glycan_count", "glyconnect_supported")


@add("JN7", f"WITH {an.SITES}, c AS (SELECT accession, position, array_to_string(list_sort(list(DISTINCT cluster_id))[1:3], ';') ortholog_clusters FROM links GROUP BY 1, 2), p AS (SELECT CAST(p_partkey AS VARCHAR) accession, 2 AS position FROM part) SELECT accession, position, ortholog_clusters FROM p LEFT JOIN c USING (accession, position)")
def _(s, d):
    sites = an.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("accession"), F.lit(2).alias("position"))
    return st.site_clusters(sites, _links(s, d))


@add("JN11", f"WITH {an.NEAR} SELECT case_accession, control_accession, brand subtype_case, brand subtype_control FROM near")
def _(s, d):
    side = lambda kind: an.side(s, d, kind).withColumnRenamed("brand", "subtype")
    return ma.checked_subtypes(_edges(s, d), side("PROMO"), side("ECONOMY")).select("case_accession", "control_accession", "subtype_case", "subtype_control")


@add("JN13", f"WITH {an.NEAREST}, {an.SCORES}, part_scored AS (SELECT * FROM scores WHERE CAST(accession AS BIGINT) % 3 <> 0) SELECT case_accession, count(*) n_controls, round(avg(b.score), 4) control_mean_score FROM nearest JOIN part_scored a ON case_accession = a.accession JOIN part_scored b ON control_accession = b.accession WHERE match_rank <= 3 GROUP BY 1")
def _(s, d):
    some = an.scores(s, d).withColumn("score", F.when(F.col("accession").cast("long") % 3 != 0, F.col("score")))
    return inf.contrasts(_nearest(s, d), some).select("case_accession", "n_controls", rounded("control_mean_score", 4).alias("control_mean_score"))


@add("JN14", f"WITH {an.NEAREST}, r AS (SELECT CAST(p_partkey AS VARCHAR) k, p_size v FROM part WHERE p_size % 4 <> 0) SELECT case_accession, control_accession, a.v case_retained, b.v control_retained FROM nearest JOIN r a ON case_accession = a.k JOIN r b ON control_accession = b.k WHERE match_rank <= 3")
def _(s, d):
    kept = an.table(s, d, "part").where("p_size % 4 <> 0").select(F.col("p_partkey").cast("string").alias("accession"), F.lit(1).alias("position"), F.col("p_size").alias("retained"))
    return inf.pair_values(_nearest(s, d), kept, "retained").select("case_accession", "control_accession", "case_retained", "control_retained")


@add("JN17", f"WITH {_CONTRASTS} SELECT case_accession, CASE CAST(case_accession AS BIGINT) % 3 WHEN 0 THEN 'k' || case_accession ELSE 'solo:' || case_accession END ortholog_cluster FROM contrasts")
def _(s, d):
    key = F.col("p_partkey")
    listed = F.when(key % 3 == 0, F.concat(F.lit("k"), key, F.lit(";z"))).when(key % 3 == 1, F.lit(""))
    clusters = an.table(s, d, "part").select(key.cast("string").alias("accession"), F.lit(1).alias("position"), listed.alias("ortholog_clusters"))
    return inf.contrasts(_nearest(s, d), an.scores(s, d), clusters).select("case_accession", "ortholog_cluster")


@add("SRT7", f"WITH {_CONTRASTS} SELECT case_accession, round(case_score - control_mean_score, 4) contrast FROM contrasts ORDER BY case_score - control_mean_score, case_accession")
def _(s, d):
    return inf.ordered_contrasts(_contrasts(s, d)).select("case_accession", rounded("contrast", 4).alias("contrast"))


def _centred(s: SparkSession, d: str) -> DataFrame:
    return an.table(s, d, "customer").select("c_nationkey", F.round(F.col("c_acctbal") - 4500, -2).alias("v"))


_WILCOXON = """x AS (SELECT 'n' || c_nationkey AS class, round(c_acctbal - 4500, -2) v FROM customer UNION ALL SELECT c_nationkey || '-' || c_mktsegment, c_acctbal - 4500 FROM customer),
r AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY abs(v)) + (count(*) OVER (PARTITION BY class, abs(v)) - 1) / 2.0 rk, count(*) OVER (PARTITION BY class, abs(v)) k FROM x WHERE v <> 0),
t AS (SELECT class, count(*) n, coalesce(sum(rk) FILTER (v > 0), 0) w_plus, coalesce(sum(rk) FILTER (v < 0), 0) w_minus, sum(k * k - 1) ties FROM r GROUP BY 1),
zeros AS (SELECT class, count(*) FILTER (v = 0) zeros FROM x GROUP BY 1),
ways AS (SELECT CAST(0 AS BIGINT) m, [CAST(1 AS DOUBLE)] w UNION ALL SELECT m + 1, [coalesce(w[i], 0) + CASE WHEN i > m + 1 THEN w[i - m - 1] ELSE 0 END for i in range(1, len(w) + m + 2)] FROM ways WHERE m < 50),
z AS (SELECT *, least(w_plus, w_minus) least_w, CASE WHEN n > 0 AND n * (n + 1) * (2 * n + 1) / 24 - ties / 48 > 0 THEN (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) END z FROM t JOIN zeros USING (class)),
tails AS (SELECT *, CASE WHEN ties = 0 AND zeros = 0 AND n <= 50 THEN 2 * list_sum(w[1:CAST(floor(least_w) AS BIGINT) + 1]) / pow(2, n)
  ELSE 1 - 2 / sqrt(pi()) * list_sum([exp(2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(greatest(abs(z), 1e-9) / sqrt(2)) - z * z / 2) for k in range(0, 200)]) END tail FROM z LEFT JOIN ways ON m = n)"""


@add("STAT10", f"WITH RECURSIVE {_WILCOXON} SELECT class, n, w_plus, w_minus, round(z, 6) z, round(least(1, tail), 6) p FROM tails")
def _(s, d):
    """Nations with rounded, tied values (normal) and their segments with values as they are (exact up to 50)."""
    segments = an.table(s, d, "customer").select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("class"), (F.col("c_acctbal") - 4500).alias("v"))
    nations = _centred(s, d).select(F.concat(F.lit("n"), "c_nationkey").alias("class"), "v")
    return inf.signed_rank_tests(nations.unionAll(segments), "class", "v").select("class", "n", "w_plus", "w_minus", r6("z"), r6("p"))


@add("STAT11", "WITH c AS (SELECT c_nationkey, count(*) FILTER (round(c_acctbal - 4500, -2) > 0) k, count(*) FILTER (round(c_acctbal - 4500, -2) <> 0) n FROM customer GROUP BY 1) SELECT c_nationkey, k, n, round(CASE WHEN 2 * k = n THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 6) p FROM c")
def _(s, d):
    return inf.sign_tests(_centred(s, d), "c_nationkey", "v").select("c_nationkey", "k", "n", r6("p"))


@add("FN35", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN CAST(l_quantity AS BIGINT) % 8 = 1 THEN (l_quantity - 1) / 8 + 0.12 WHEN CAST(l_quantity AS BIGINT) % 8 = 3 THEN (l_quantity - 3) / 8 + 0.38 WHEN CAST(l_quantity AS BIGINT) % 8 = 5 THEN (l_quantity - 5) / 8 + 0.62 WHEN CAST(l_quantity AS BIGINT) % 8 = 7 THEN (l_quantity - 7) / 8 + 0.88 ELSE l_quantity / 8 END eighths FROM lineitem")
def _(s, d):
    return an.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(x.half_even(F.col("l_quantity") / 8, 2), 6).alias("eighths"))


@add("CMP1", f"""WITH {an.ASSOCIATED}, {an.FEATURES}, s AS (SELECT accession, position, bool_or(homology_qc_bucket = 'strict') st, bool_or(homology_qc_bucket IN ('strict','plausible')) sp FROM associated GROUP BY 1, 2),
e AS (SELECT s.*, coalesce({an.TIER} IN ('manual_experimental','manual_combinatorial') AND f.code IS NOT NULL, false) q FROM s LEFT JOIN (SELECT * FROM features WHERE parse_status = 'ok' AND glyco_type = 'N-linked') f USING (accession, position))
SELECT count(*) candidate_sites, count(*) FILTER (NOT q) excluded_sites, count(*) FILTER (q) all_sites, count(DISTINCT accession) FILTER (q) all_proteins, count(*) FILTER (q AND sp) strict_plus_plausible_sites, count(DISTINCT accession) FILTER (q AND sp) strict_plus_plausible_proteins,
count(*) FILTER (q AND st) strict_sites, count(DISTINCT accession) FILTER (q AND st) strict_proteins, (SELECT count(*) FROM pairs WHERE analysis_ready AND best_loss_positive_position IS NULL) null_position_rows FROM e""")
def _(s, d):
    pairs, table = an.pairs(s, d), an.annotations(s, d)
    absent = pairs.select(F.col("pos_accession").alias("accession")).distinct().join(table, "accession", "left_anti")
    return runs.baseline(pairs, an.homology(s, d), x.parse_features(table), absent, ev.Policy(), ["line_no", "homology_qc_bucket"])["counts"]
