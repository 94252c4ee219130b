"""Evidence layers on sites, their collapse to one row a site, and their combination."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import exprs as x
from siteloom.functions import vocab as v
from siteloom.operators.sites import KEY, joined_layers


@dataclass(frozen=True)
class Policy:
    """What counts as support; the names are those of the configuration."""

    qualifying_uniprot_tiers: tuple[str, ...] = ("manual_experimental", "manual_combinatorial")
    qualifying_glygen_tiers: tuple[str, ...] = ("glygen_reported_with_glycan", "glygen_reported_independent")
    qualifying_structure_tiers: tuple[str, ...] = ("structure_linked_glycan",)
    glyconnect_qualifies: bool = False
    observed_unmodified_from_internal_control: bool = True
    require_analysis_ready: bool = True
    strict_buckets: tuple[str, ...] = ("strict",)
    plausible_buckets: tuple[str, ...] = ("plausible",)

    @classmethod
    def of(cls, section: dict) -> Policy:
        """The policy of a configuration's section; a key that only reports read is left out."""
        own = {f.name for f in fields(cls)}
        return cls(**{k: tuple(x) if isinstance(x, list) else x for k, x in section.items() if k in own})


def chosen(tier: str, tiers: tuple[str, ...]) -> Column:
    """FLT6: whether a column's tier is one of the given; a missing one isn't."""
    return F.coalesce(tier, F.lit("")).isin(list(tiers))


def usable_features(features: DataFrame) -> DataFrame:
    """FLT5."""
    return features.where("parse_status = 'ok' and position is not null and glyco_type = 'N-linked'")


def code_union(features: DataFrame) -> DataFrame:
    """AGG3: all evidence codes of a site, sorted and distinct."""
    return features.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_codes")))).alias("codes"))


def annotation_layer(sites: DataFrame, features: DataFrame, absent: DataFrame, policy: Policy) -> DataFrame:
    """JN2: sites with the tier of their exact feature; an absent accession outranks an absent feature."""
    rows = sites.join(code_union(usable_features(features)), list(KEY), "left").join(absent.select("accession", F.lit(True).alias("gone")).distinct(), "accession", "left")
    tier = F.when(F.col("gone").isNotNull(), "").when(F.col("codes").isNull(), v.ABSENT_FEATURE).otherwise(x.annotation_tier(F.col("codes")))
    selected = list(policy.qualifying_uniprot_tiers)
    rows = rows.withColumn("uniprot_tier", tier)
    reason = F.when(F.col("gone"), v.ABSENT_ACCESSION).when(F.col("codes").isNull(), v.ABSENT_FEATURE).otherwise(x.exclusion_reason(F.col("uniprot_tier"), selected))
    return rows.select(*KEY, "uniprot_tier", F.when(F.col("gone").isNull(), F.array_join("codes", "|")).alias("uniprot_evidence_codes"), F.col("uniprot_tier").isin(selected).alias("uniprot_qualifies"), reason.alias("exclusion_reason")).na.fill("", ["uniprot_evidence_codes"])


def feature_inventory(features: DataFrame) -> DataFrame:
    """CMP3: every feature with its tier, usable or not."""
    return features.select("accession", "position", "glyco_type", "parse_status", F.array_join("evidence_codes", "|").alias("evidence_codes"), x.annotation_tier(F.col("evidence_codes")).alias("tier"), F.col("raw_note").alias("note"))


def glycan_sites(entries: DataFrame) -> DataFrame:
    """AGG6: entries (accession, type, start_pos, end_pos, categories, evidence, glytoucan_ac) -> one row a site."""
    good = entries.where(x.glycan_entry_usable(F.col("type"), F.col("start_pos"), F.col("end_pos")))
    databases = F.array_compact(F.transform("evidence", lambda e: F.when(F.coalesce(e["database"], F.lit("")) != "", e["database"])))
    ranks = F.create_map(*(F.lit(a) for i, t in enumerate(v.GLYCAN_TIERS) for a in (t, i)))
    rows = good.select("accession", F.col("start_pos").alias("position"), F.element_at(ranks, x.glycan_entry_tier(F.col("categories"), databases)).alias("rank"), "categories", databases.alias("databases"), x.ids_by_database(F.col("evidence"), "PubMed").alias("pubmed"), F.col("glytoucan_ac"))
    union = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), "|")
    ids = F.array_join(F.array_sort(F.collect_set(F.when(F.col("glytoucan_ac") != "", F.col("glytoucan_ac")))), "|")
    return rows.groupBy(*KEY).agg(F.element_at(F.array(*map(F.lit, v.GLYCAN_TIERS)), (F.min("rank") + 1).cast("int")).alias("glygen_tier"), union("categories").alias("glygen_categories"), union("databases").alias("glygen_evidence_databases"), union("pubmed").alias("glygen_pubmed_ids"), ids.alias("glygen_glytoucan_ids"))


def composition_sites(structures: DataFrame) -> DataFrame:
    """AGG7: structures (accession, composition_string, sites) -> hits and compositions a site."""
    rows = structures.select("accession", "composition_string", F.explode("sites").alias("s")).select("accession", x.site_label_position(F.col("s.site")).alias("position"), "composition_string").where("position is not null")
    return rows.groupBy(*KEY).agg(F.count("*").alias("glyconnect_glycan_count"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("composition_string") != "", F.col("composition_string")))), "|").alias("glyconnect_compositions"))


def layer_on_sites(sites: DataFrame, layer: DataFrame) -> DataFrame:
    """JN5: every site once, blanks where the layer has no record."""
    out = sites.select(*KEY).join(layer, list(KEY), "left")
    if "glyconnect_glycan_count" in layer.columns:
        out = out.withColumn("glyconnect_supported", F.col("glyconnect_glycan_count").isNotNull())
    return out.na.fill("").na.fill(0)


def combine(annotation: DataFrame, layers: list[DataFrame], policy: Policy) -> DataFrame:
    """CMP2's core: support, occupancy and exclusion of every site over the layers that are there."""
    rows = joined_layers(annotation, layers)
    has = set(rows.columns)
    flags = {"uniprot": F.col("uniprot_qualifies")} if "uniprot_qualifies" in has else {}
    if "glygen_tier" in has:
        flags["glygen"] = chosen("glygen_tier", policy.qualifying_glygen_tiers)
    if "glyconnect_supported" in has and policy.glyconnect_qualifies:
        flags["glyconnect"] = F.col("glyconnect_supported")
    if "structure_tier" in has:
        flags["structure"] = chosen("structure_tier", policy.qualifying_structure_tiers)
    names, count, positive = x.support(flags)
    bare = F.col("structure_internal_control") if "structure_internal_control" in has and policy.observed_unmodified_from_internal_control else F.lit(False)
    rows = rows.withColumns({"support_sources": names, "support_count": count, "experimental_positive": positive})
    return rows.withColumns({"occupancy_status": x.occupancy(F.col("experimental_positive"), bare), "exclusion_reason": F.when(F.col("experimental_positive"), "").otherwise(F.col("exclusion_reason"))})


def layer_support(combined: DataFrame) -> DataFrame:
    """AGG5: how many sites each layer supports."""
    return combined.agg(*(F.count_if(F.array_contains(F.split("support_sources", r"\|"), n)).alias(f"n_{n}") for n in v.LAYERS))
