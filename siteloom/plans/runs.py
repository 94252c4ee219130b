"""End-to-end runs: the annotation baseline, all layers, and the primary analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import exprs as x
from siteloom.functions import vocab as v
from siteloom.operators import evidence as ev
from siteloom.operators import inference as inf
from siteloom.operators import sites as st
from siteloom.operators import structures as sr
from siteloom.operators.graph import cut


def baseline(pairs: DataFrame, homology: DataFrame, features: DataFrame, absent: DataFrame, policy: ev.Policy, order: list) -> dict[str, DataFrame]:
    """CMP1: the site universe, its subsets, its annotation evidence, the parts of it and how large they are."""
    universe = st.candidate_sites(pairs, policy.require_analysis_ready)
    links = st.associations(pairs, homology, order, policy.require_analysis_ready)
    subset = st.subsets(links, policy.strict_buckets, policy.plausible_buckets)
    evidence = st.joined_layers(ev.annotation_layer(universe, features, absent, policy), [subset])
    return {"sites": universe, "associations": links, "subsets": subset, "evidence": evidence, "qualifying": evidence.where("uniprot_qualifies"), "excluded": evidence.where("not uniprot_qualifies"), "inventory": ev.feature_inventory(features), "counts": baseline_counts(evidence, st.missing_positions(st.ready(pairs, policy.require_analysis_ready)))}


def baseline_counts(evidence: DataFrame, missing: DataFrame) -> DataFrame:
    """CMP1: its nine counts in one pass over the evidence."""
    good = F.col("uniprot_qualifies")
    parts = {"all": good, "strict_plus_plausible": good & F.coalesce("in_strict_plus_plausible", F.lit(False)), "strict": good & F.coalesce("in_strict", F.lit(False))}
    each = [c for name, test in parts.items() for c in (F.count_if(test).alias(f"{name}_sites"), F.countDistinct(F.when(test, F.col("accession"))).alias(f"{name}_proteins"))]
    counts = evidence.agg(F.count("*").alias("candidate_sites"), F.count_if(~good).alias("excluded_sites"), *each)
    return counts.crossJoin(F.broadcast(missing.withColumnRenamed("n_missing", "null_position_rows")))  # one row each


def full(base: dict[str, DataFrame], layers: list[DataFrame], policy: ev.Policy) -> dict[str, DataFrame]:
    """CMP2: all layers combined, split, counted."""
    combined = ev.combine(base["evidence"], layers, policy)
    parts = st.splits(combined)
    return {"combined": combined, **parts, "layer_support": ev.layer_support(combined)}


def primary(pairs: DataFrame, scores: DataFrame, clusters: DataFrame | None, n_draws: int, margin_sd: float = 0.2, subtypes: DataFrame | None = None) -> dict[str, DataFrame]:
    """CMP10: contrasts and their units, interval, verdict, robustness and subtypes of one comparison.

    subtypes (accession, position, subtype) are those of the cases; without them that table is left out.
    """
    rows = cut(inf.resample_units(inf.contrasts(pairs, scores, clusters)))
    sd = inf.reference_sd(scores).select(F.coalesce("reference_sd", F.lit(0.0)).alias("reference_sd"))
    draws = inf.interval(inf.bootstrap_draws(rows, "resample_unit", "contrast", n_draws))
    verdict = draws.crossJoin(F.broadcast(sd)).withColumn("verdict", x.verdict(F.col("ci_low"), F.col("ci_high"), margin_sd * F.col("reference_sd"))).drop("reference_sd")  # one row each
    reuse = inf.control_reuse(rows).agg(F.max("count").alias("most_used_control"))
    made = {"contrasts": rows, "verdict": verdict, "location": inf.robust_location(rows), "control_reuse": reuse}
    if subtypes is not None:
        own = subtypes.select(F.col("accession").alias("case_accession"), F.col("position").alias("case_position"), "subtype")
        made["subtypes"] = inf.subtypes(rows.join(own, ["case_accession", "case_position"]), "subtype", "contrast")
    return made


def candidate_manifest(features: DataFrame, links: DataFrame, sequences: DataFrame, chain_rows: DataFrame, index: DataFrame, status: tuple[str, ...] = (v.OCCUPIED, v.UNMODIFIED)) -> tuple[DataFrame, DataFrame]:
    """CMP9, CMP6: (manifest, exclusions) of the featured sites of the given classes, with their clusters.

    features has the site, its status, its structure and its chain; every row ends up in one of the two.
    """
    rows = st.of_class(st.site_clusters(features.where("features_available"), links), *status)
    rows = rows.join(sequences.select("accession", "sequence"), "accession", "left")
    rows = rows.withColumn("stem", F.upper("structure_pdb_id")).join(index.select("stem", "path"), "stem", "left").drop("stem").withColumnRenamed("structure_chain_id", "chain_id")
    mapped = sr.map_sequons(rows, chain_rows).drop("sequence", "path").withColumnRenamed("chain_id", "structure_chain_id")
    return mapped.where("exclusion_reason is null").drop("exclusion_reason"), mapped.where("exclusion_reason is not null")
