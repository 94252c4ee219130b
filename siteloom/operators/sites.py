"""The site universe: readiness, positions, associations, subsets, keep-first, sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.operators.ranks import numbered

KEY = ("accession", "position")
MODEL_KEY = ("accession", "position", "structure_pdb_id", "structure_chain_id")
ASSOCIATION = ("pair_id", "cluster_id", "neg_accession", "source")


def ready(pairs: DataFrame, require: bool = True) -> DataFrame:
    """FLT1: rows marked ready; a required but missing column is an error."""
    if not require:
        return pairs
    if "analysis_ready" not in pairs.columns:
        raise KeyError("analysis_ready")
    return pairs.where(F.coalesce("analysis_ready", F.lit(False)))


def positioned(pairs: DataFrame, column: str = "best_loss_positive_position") -> DataFrame:
    """FLT2, FLT3: accession and position with a known position, cast."""
    known = pairs.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return known.withColumns({"accession": F.col("pos_accession").cast("string"), "position": F.col(column).cast("int")})


def missing_positions(pairs: DataFrame, column: str = "best_loss_positive_position") -> DataFrame:
    """FLT2: how many ready rows have no position."""
    return pairs.agg(F.count_if(F.col(column).isNull() | F.isnan(F.col(column).cast("double"))).alias("n_missing"))


def candidate_sites(pairs: DataFrame, require: bool = True) -> DataFrame:
    """AGG1: the distinct sites."""
    return positioned(ready(pairs, require)).select(*KEY).distinct()


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """DDP1-DDP5: the first row of each key in a stated order.

    Keys with many rows are reduced in each task before the shuffle, by a minimum over (order, row).
    """
    others = [c for c in rows.columns if c not in keys]
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first_row"))
    return firsts.select(*keys, "first_row.*").select(*rows.columns)


def with_missing(rows: DataFrame, columns: tuple[str, ...], kind: str = "string") -> DataFrame:
    """FLT4, FLT11: the columns in order, null where absent."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c in columns))


def associations(pairs: DataFrame, homology: DataFrame, order: list[str | Column], require: bool = True) -> DataFrame:
    """JN1: each site's pairs with their homology bucket (the first by ``order`` for a pair id)."""
    sites = positioned(ready(pairs, require))
    buckets = keep_first(homology, ["pair_id"], order).select("pair_id", "homology_qc_bucket")
    return with_missing(sites, (*KEY, *ASSOCIATION)).join(buckets, "pair_id", "left").select(*KEY, *ASSOCIATION, "homology_qc_bucket")


def subsets(links: DataFrame, strict: tuple[str, ...] = ("strict",), plausible: tuple[str, ...] = ("plausible",)) -> DataFrame:
    """AGG2: per site whether any pair is strict, strict or plausible, and how many pairs there are."""
    bucket = F.coalesce("homology_qc_bucket", F.lit(""))
    return links.groupBy(*KEY).agg(F.bool_or(bucket.isin(*strict)).alias("in_strict"), F.bool_or(bucket.isin(*strict, *plausible)).alias("in_strict_plus_plausible"), F.count("pair_id").alias("n_associations"))


def splits(combined: DataFrame) -> dict[str, DataFrame]:
    """FLT7: the named parts of the combined table."""
    positive, strict, plausible = (F.coalesce(c, F.lit(False)) for c in ("experimental_positive", "in_strict", "in_strict_plus_plausible"))
    return {"all": combined.where(positive), "strict": combined.where(positive & strict), "strict_plus_plausible": combined.where(positive & plausible), "excluded": combined.where(~positive), "curator": combined.where(F.col("uniprot_tier") == "manual_curator_inference")}


def clusters(links: DataFrame, most: int = 3) -> DataFrame:
    """AGG8: the first few cluster ids of a site, sorted as text."""
    ids = F.array_sort(F.collect_set(F.col("cluster_id").cast("string")))
    return links.where("cluster_id is not null").groupBy(*KEY).agg(F.array_join(F.slice(ids, 1, most), ";").alias("ortholog_clusters"))


def in_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """FLT12, JN20: rows whose key occurs in the other table."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def not_in_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """FLT13, JN19."""
    return rows.join(keys.select(*on), on, "left_anti")


def joined_layers(base: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """JN3, JN4: left joins of the layers that are there, on the site key."""
    return reduce(lambda a, b: a.join(b, list(KEY), "left"), layers, base)


def one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """JN18: inner join of two tables with unique keys; a key that occurs twice in either is an error."""
    for side, name in ((a, "left"), (b, "right")):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"keys of the {name} side repeat")
    return a.join(b, on)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """SET1: all rows of all tables, columns by name, null where a table has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def crosstab(rows: DataFrame, *by: str) -> DataFrame:
    """AGG11: how many rows there are of each combination."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, by: str, k: int) -> DataFrame:
    """AGG29, SRT4: the k most frequent values, ties by value."""
    return rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(k)


def first_known(rows: DataFrame, by: list[str], value: str, order: list[str | Column]) -> DataFrame:
    """AGG33: the first value of each group that isn't null, in a stated order."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def site_clusters(sites: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """JN7: every site with the list of its clusters, null where it has none."""
    return sites.join(clusters(links, most), list(KEY), "left")


def of_class(rows: DataFrame, *status: str, column: str = "occupancy_status") -> DataFrame:
    """FLT9: rows of the given classes."""
    return rows.where(F.col(column).isin(*status))


def scoreable_only(rows: DataFrame) -> DataFrame:
    """FLT8: rows known to be scoreable; an unknown one isn't."""
    return rows.where(F.coalesce("scoreable", F.lit(False)))


def present(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """FLT11: those of the columns that the table has, in the order asked for."""
    return rows.select(*(c for c in columns if c in rows.columns))


def counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG4: rows and distinct accessions."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n_sites"), F.countDistinct("accession").alias("n_proteins"))


def shard(rows: DataFrame, group: list[str], part: str) -> DataFrame:
    """FLT14: rows of the groups whose place in the sorted order of groups is K modulo N ("K/N")."""
    k, n = (int(x) for x in part.split("/"))
    if not 0 <= k < n:
        raise ValueError(part)
    order = numbered(rows.select(*group).distinct(), group, "group_at")
    return rows.join(order.where(F.col("group_at") % n == k).drop("group_at"), group, "left_semi")


def merged_shards(parts: list[DataFrame], keys: list[str], order: list[str | Column]) -> DataFrame:
    """SNK8: union by name, first row of each key."""
    return keep_first(stacked(parts), keys, order)


def missing_shards(found: DataFrame, n: int) -> DataFrame:
    """SNK8: the shard numbers from 0 to n - 1 without a row in found (shard)."""
    return found.sparkSession.range(n).select(F.col("id").cast("int").alias("shard")).join(found.select("shard"), "shard", "left_anti")
