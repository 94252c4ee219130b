"""Contrasts of matched sites and what can be said of them."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from siteloom.functions.exprs import no_nan, verdict
from siteloom.operators import matching as ma
from siteloom.operators import picks
from siteloom.operators.graph import components, cut
from siteloom.operators.order_statistics import quantiles
from siteloom.operators.ranks import numbered, running, seeded


#: Units whose sums one task may hold as arrays; more of them are joined instead.
HELD_UNITS = 2_000_000


def contrasts(pairs: DataFrame, scores: DataFrame, clusters: DataFrame | None = None, value: str = "score") -> DataFrame:
    """JN13, AGG17, JN17: each case's score less its controls' mean.

    Cases without a score, or without any scored control, are left out. Scores are added up in order of size, so
    that a mean is the same in every run.
    """
    s = scores.select("accession", "position", no_nan(F.col(value).cast("double")).alias("s")).where("s is not null")
    a = s.select(F.col("accession").alias("case_accession"), F.col("position").alias("case_position"), F.col("s").alias("case_score"))
    b = s.select(F.col("accession").alias("control_accession"), F.col("position").alias("control_position"), F.col("s").alias("control_score"))
    rows = pairs.join(a, ["case_accession", "case_position"]).join(b, ["control_accession", "control_position"])
    out = rows.groupBy("case_accession", "case_position").agg(F.first("case_score").alias("case_score"), F.array_sort(F.collect_list("control_score")).alias("control_scores"), F.count("*").alias("n_controls"), F.array_join(F.array_sort(F.collect_set("control_accession")), ";").alias("control_proteins"))
    mean = F.aggregate("control_scores", F.lit(0.0), lambda a, c: a + c) / F.col("n_controls")
    out = out.withColumn("control_mean_score", mean).drop("control_scores")
    out = out.withColumn("contrast", F.col("case_score") - F.col("control_mean_score"))
    return with_cluster(out, clusters)


def with_cluster(cases: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """JN17: each case with the first of its site's clusters, or one of its own."""
    first = F.lit(None).cast("string")
    if clusters is not None:
        cases = cases.hint("merge").join(clusters.select(F.col("accession").alias("case_accession"), F.col("position").alias("case_position"), "ortholog_clusters"), ["case_accession", "case_position"], "left")
        first = F.get(F.split("ortholog_clusters", ";"), F.lit(0))
    return cases.withColumn("ortholog_cluster", F.coalesce(F.when(first != "", first), F.concat(F.lit("solo:"), "case_accession"))).drop("ortholog_clusters")


def with_status(rows: DataFrame, manifest: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """JN9: rows with their status, blank if the manifest lacks them, and scoreability, false if unknown."""
    out = rows.join(manifest, on, "left").join(known, on, "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("")), "scoreable": F.coalesce("scoreable", F.lit(False))})


def with_scores(manifest: DataFrame, scores: DataFrame, on: list[str], value: str = "score") -> DataFrame:
    """JN8: manifest rows that have a score; a NaN is none."""
    return manifest.join(scores.select(*on, no_nan(F.col(value).cast("double")).alias(value)).where(F.col(value).isNotNull()), on)


def pair_values(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """JN14: pairs with both sides' values; a pair that lacks one is left out."""
    side = lambda s: values.select(F.col("accession").alias(f"{s}_accession"), F.col("position").alias(f"{s}_position"), F.col(value).alias(f"{s}_{value}"))
    return pairs.join(side("case"), ["case_accession", "case_position"]).join(side("control"), ["control_accession", "control_position"])


def subtypes(rows: DataFrame, by: str, value: str) -> DataFrame:
    """AGG19: number, mean, and mean in standard deviations of each subtype."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.avg(value) / F.stddev_samp(value)).alias("in_sd"))


def box_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """AGG30: exact quartiles of each class."""
    return quantiles(rows, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, (by,))


def control_reuse(rows: DataFrame) -> DataFrame:
    """AGG18: how many contrasts each control protein takes part in."""
    return rows.select(F.explode(F.split("control_proteins", ";")).alias("control")).groupBy("control").count()


def ordered_contrasts(rows: DataFrame, value: str = "contrast") -> DataFrame:
    """SRT7: contrasts from least to greatest, ties by case."""
    return rows.orderBy(value, "case_accession", "case_position")


def resample_units(rows: DataFrame) -> DataFrame:
    """STAT6: cases that share a cluster or a control protein, directly or through others, are one unit."""
    edges = rows.select(F.concat(F.lit("cluster:"), "ortholog_cluster").alias("a"), F.explode(F.split("control_proteins", ";")).alias("c")).select("a", F.concat(F.lit("control:"), "c").alias("b"))
    found = components(edges).select(F.col("node").alias("a"), F.col("component").alias("resample_unit"))
    return rows.withColumn("a", F.concat(F.lit("cluster:"), "ortholog_cluster")).join(found, "a").drop("a")


def reference_sd(scores: DataFrame, value: str = "score") -> DataFrame:
    """AGG12."""
    return scores.agg(F.stddev_samp(no_nan(F.col(value).cast("double"))).alias("reference_sd"))


def robust_location(rows: DataFrame, value: str = "contrast", trim: float = 0.1) -> DataFrame:
    """AGG20: mean, median, trimmed mean, share of positives, range of leave-one-out means."""
    x = rows.select(F.col(value).alias("x")).where("x is not null")
    n_sum = x.agg(F.count("*").alias("n"), F.sum("x").alias("t"))
    ranked = running(x.groupBy("x").agg(F.count("*").alias("k")), ["x"], F.col("k"), "upto")
    ranked = ranked.crossJoin(F.broadcast(n_sum)).withColumn("skip", F.floor(F.col("n") * trim))  # one row
    inside = F.greatest(F.least(F.col("upto"), F.col("n") - F.col("skip")) - F.greatest(F.col("upto") - F.col("k"), F.col("skip")), F.lit(0))
    trimmed = ranked.agg((F.sum(F.col("x") * inside) / F.sum(inside)).alias("trimmed_mean"))
    plain = x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.count_if(F.col("x") > 0).alias("n_positive"), F.sum("x").alias("t"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    one_out = lambda c: F.when(F.col("n") > 1, (F.col("t") - F.col(c)) / (F.col("n") - 1))
    return plain.crossJoin(F.broadcast(trimmed)).crossJoin(F.broadcast(quantiles(x, "x", {"median": 0.5}))).select("n", "mean", "median", "trimmed_mean", "n_positive", one_out("hi").alias("loo_min"), one_out("lo").alias("loo_max"))


def pick(draw: Column, slot: Column, n: Column | int, salt: str = "") -> Column:
    """A reproducible pick from 0 to n - 1, equal in any SQL engine with md5."""
    digest = F.md5(F.concat_ws("-", F.lit(salt), draw.cast("string"), slot.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def numbered_units(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """Units in order of name: (unit_at, s, n)."""
    sums = rows.where(F.col(unit).isNotNull() & F.col(value).isNotNull()).groupBy(unit).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    return numbered(sums, [unit], "unit_at").select("unit_at", "s", "n")


def bootstrap_draws(rows: DataFrame, unit: str, value: str, n_draws: int, salt: str = "b") -> DataFrame:
    """STAT1-STAT3: means of resampled units, one row a draw.

    Units are reduced to sums first. Up to HELD_UNITS of them go to the tasks as two arrays and each draw
    sums its picks there, without a shuffle; beyond, picks are rows that are joined with the units.
    """
    units, spark = numbered_units(rows, unit, value), rows.sparkSession
    draws = spark.range(n_draws).withColumnRenamed("id", "draw")
    slots = F.sequence(F.lit(0).cast("long"), F.col("u") - 1)
    if units.count() <= HELD_UNITS:
        # an aggregate's list has no order of its own: the units' numbers give it
        listed = units.agg(F.array_sort(F.collect_list(F.struct("unit_at", "s", "n"))).alias("l"), F.count("*").alias("u"))
        held = listed.select("u", F.transform("l", lambda x: x["s"]).alias("sums"), F.transform("l", lambda x: x["n"]).alias("sizes")).where("u > 0")
        each = draws.crossJoin(F.broadcast(held)).withColumn("picks", F.transform(slots, lambda slot: pick(F.col("draw"), slot, F.col("u"), salt).cast("int")))
        both = F.aggregate("picks", F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct((a["s"] + F.get("sums", i)).alias("s"), (a["n"] + F.get("sizes", i)).alias("n")))
        return each.select("draw", both.alias("t")).select("draw", (F.col("t.s") / F.col("t.n")).alias("mean"))
    size = units.agg(F.count("*").alias("u"))
    picked = draws.crossJoin(F.broadcast(size)).select("draw", "u", F.explode(slots).alias("slot")).select("draw", pick(F.col("draw"), F.col("slot"), F.col("u"), salt).alias("unit_at"))  # size is one row
    return picked.join(units, "unit_at").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("mean"))


def bootstrap_by(rows: DataFrame, by: list[str], unit: str, value: str, n_draws: int, salt: str = "b") -> DataFrame:
    """STAT1-STAT3 of every class at once: (by, draw, mean), picks keyed by class, draw and slot.

    One plan, however many classes: units are summed, and a class's units go to one task, or to a few that share its
    draws where classes are fewer than cores. The task numbers them by name and makes their picks block by block.
    A class of more than HELD_UNITS units is numbered from a running count over all and has its picks joined instead.
    """
    known = rows.select(*by, F.col(unit).alias("unit_name"), F.col(value).alias("unit_value")).where(reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.expr("unit_name is not null and unit_value is not null")))
    sums = cut(known.groupBy(*by, "unit_name").agg(F.sum("unit_value").cast("double").alias("s"), F.count("*").alias("n")))
    sizes = cut(sums.groupBy(*by).agg(F.count("*").alias("n_units")))
    key = F.concat_ws("-", F.lit(salt), *(F.col(c).cast("string") for c in by))
    spark = rows.sparkSession
    parts = max(1, min(n_draws, -(-4 * spark.sparkContext.defaultParallelism // max(1, sizes.count()))))
    held = sums.join(sizes.where(F.col("n_units") <= HELD_UNITS), by).withColumns({"key": key, "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    # dealt by number: a class's units are few bytes beside the picks made from them
    held = held.select(*by, "part", "key", "unit_name", "s", "n").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by, "part")

    def drawn(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["unit_name"]))
        part = table["part"][0].as_py()
        low, high = part * n_draws // parts, (part + 1) * n_draws // parts
        found = picks.means(table["key"][0].as_py().encode(), (low, high), table["s"].to_numpy(), table["n"].to_numpy())
        names = table.select(by).take(pa.array(np.zeros(high - low, int)))
        return names.append_column("draw", pa.array(np.arange(low, high))).append_column("mean", pa.array(found))

    schema = StructType([*(known.schema[c] for c in by), StructField("draw", LongType()), StructField("mean", DoubleType())])
    means = held.groupBy(*by, "part").applyInArrow(drawn, schema)
    large = sizes.where(F.col("n_units") > HELD_UNITS)
    if large.isEmpty():
        return means
    every = cut(numbered(sums.join(large, by), [*by, "unit_name"], "at"))
    units = every.join(every.groupBy(*by).agg(F.min("at").alias("start")), by).withColumn("unit_at", F.col("at") - F.col("start"))
    ahead = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    slots = large.select(*by, "n_units", key.alias("key"), ahead(F.lit(n_draws).cast("long")).alias("draw")).withColumn("slot", ahead(F.col("n_units")))
    choose = F.conv(F.substring(F.md5(F.concat_ws("-", "key", F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n_units")
    picked = slots.select(*by, "draw", choose.alias("unit_at")).join(units, [*by, "unit_at"]).groupBy(*by, "draw").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.unionByName(picked)


def sweep(pairs: DataFrame, scores: DataFrame, clusters: DataFrame | None, n_draws: int, salt: str = "sweep", margin_sd: float = 0.2) -> DataFrame:
    """STAT15 to AGG24's input: pairs (seed, case, control) -> (seed, n_pairs, mean, ci_low, ci_high, verdict).

    The verdict's margin is ``margin_sd`` standard deviations of all scores.

    Contrasts, resampling units and intervals of all seeds are found together: names of clusters and controls
    carry their seed, so that one run over the graph labels the units of every seed.
    """
    s = scores.select("accession", "position", no_nan(F.col("score").cast("double")).alias("s")).where("s is not null")
    side = lambda k: s.select(F.col("accession").alias(f"{k}_accession"), F.col("position").alias(f"{k}_position"), F.col("s").alias(f"{k}_score"))
    scored = pairs.join(side("case"), ["case_accession", "case_position"]).join(side("control"), ["control_accession", "control_position"])
    rows = scored.groupBy("seed", "case_accession", "case_position").agg((F.first("case_score") - F.avg("control_score")).alias("contrast"), F.array_sort(F.collect_set("control_accession")).alias("controls"))
    rows = cut(with_cluster(rows, clusters))
    name = lambda kind, c: F.concat_ws(":", "seed", F.lit(kind), c)
    found = components(rows.select(name("cluster", "ortholog_cluster").alias("a"), F.explode("controls").alias("c"), "seed").select("a", name("control", "c").alias("b")))
    units = rows.withColumn("node", name("cluster", "ortholog_cluster")).join(found.withColumnRenamed("component", "resample_unit"), "node")
    ends = interval(bootstrap_by(units, ["seed"], "resample_unit", "contrast", n_draws, salt), by=("seed",))
    means = rows.groupBy("seed").agg(F.count("*").alias("n_pairs"), F.avg("contrast").alias("mean"))
    return _judged(means.join(ends, "seed"), scores, margin_sd)


def _judged(swept: DataFrame, scores: DataFrame, margin_sd: float) -> DataFrame:
    margin = reference_sd(scores).select((F.lit(margin_sd) * F.col("reference_sd")).alias("margin"))  # one row
    return swept.crossJoin(F.broadcast(margin)).withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high"), F.col("margin"))).drop("margin")


def greedy_sweep(cases: DataFrame, controls: DataFrame, scores: DataFrame, clusters: DataFrame | None, features: list[str], caliper: float, exact: tuple[str, ...], k: int, seeds: tuple[int, ...], n_draws: int, salt: str = "sweep", margin_sd: float = 0.2) -> DataFrame:
    """STAT13 to STAT5: sweep(greedy_controls(...)).

    Where no two cases share a cluster and no two controls a protein, no two contrasts can share a unit, whatever the seed: contrasts
    are made where pairs are found, and all draws of a seed where its contrasts meet. Otherwise, or if units are more than HELD_UNITS,
    pairs are labelled with their units first.
    """
    sites = cut(with_cluster(cases.select("*", F.col("accession").alias("case_accession"), F.col("position").alias("case_position")), clusters).drop("case_accession", "case_position"))
    most = lambda rows, c: rows.groupBy(c).count().agg(F.max("count"), F.sum("count")).first()
    (shared, n_cases), (reused, n_controls) = most(sites, "ortholog_cluster"), most(controls, "accession")
    if max(shared or 0, reused or 0) > 1 or min(n_cases or 0, n_controls or 0) > HELD_UNITS:
        return sweep(ma.greedy_controls(cases, controls, features, caliper, exact, k, seeds), scores, clusters, n_draws, salt, margin_sd)
    known = cut(scores.select("accession", "position", no_nan(F.col("score").cast("double")).alias("score")).where("score is not null"))
    scored = lambda rows: rows.drop("score").join(known, ["accession", "position"], "left")
    found = ma.greedy_contrasts(scored(numbered(sites, ["ortholog_cluster"], "unit_at")), scored(controls), features, caliper, exact, k, seeds)
    spark = cases.sparkSession
    parts = max(1, min(n_draws, -(-4 * spark.sparkContext.defaultParallelism // max(1, len(seeds)))))
    # dealt by number: a seed's contrasts are few bytes beside the picks made from them
    dealt = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "seed", "part")

    def drawn(table: pa.Table) -> pa.Table:
        seed, part = table["seed"][0].as_py(), table["part"][0].as_py()
        x = table["contrast"].to_numpy()[np.argsort(table["unit_at"].to_numpy())]
        means = picks.means(f"{salt}-{seed}".encode(), (part * n_draws // parts, (part + 1) * n_draws // parts), x, np.ones(len(x), int))
        return pa.table({"seed": pa.array([seed], pa.int32()), "n_pairs": pa.array([len(x)]), "mean": pa.array([x.mean()]), "draws": pa.array([means])})

    drawn_ = cut(dealt.groupBy("seed", "part").applyInArrow(drawn, "seed int, n_pairs long, mean double, draws array<double>"))
    ends = interval(drawn_.select("seed", F.explode("draws").alias("draw_mean")), "draw_mean", by=("seed",))
    return _judged(drawn_.select("seed", "n_pairs", "mean").distinct().join(ends, "seed"), known, margin_sd)


def interval(draws: DataFrame, value: str = "mean", low: float = 0.025, high: float = 0.975, by: tuple[str, ...] = ()) -> DataFrame:
    """STAT4: exact percentiles with linear interpolation, of each class of ``by``."""
    return quantiles(draws, value, {"ci_low": low, "ci_high": high}, by)


def seeded_bootstrap(rows: DataFrame, unit: str, value: str, n_draws: int, seed: int, most_units: int = 100_000) -> DataFrame:
    """STAT1 with numpy's stream: one generator call for all draws, dealt to tasks by draw.

    The units' sums are broadcast; more than ``most_units`` of them are refused, bootstrap_draws has no limit.
    """
    sums = rows.where(F.col(unit).isNotNull() & F.col(value).isNotNull()).groupBy(unit).agg(F.sum(value).alias("s"), F.count("*").alias("n")).orderBy(unit).limit(most_units + 1).toPandas()
    if len(sums) > most_units:
        raise ValueError("too many units for one generator")
    s, n = sums["s"].to_numpy(float), sums["n"].to_numpy(float)
    sent = rows.sparkSession.sparkContext.broadcast((s, n))

    def run(batches):
        s, n = sent.value
        for pdf in batches:
            out = []
            for draw in pdf["id"]:
                picks = np.random.default_rng([seed, int(draw)]).integers(0, len(s), len(s))
                out.append(s[picks].sum() / n[picks].sum() if len(s) else math.nan)
            yield pd.DataFrame({"draw": pdf["id"], "mean": out})

    return rows.sparkSession.range(n_draws).mapInPandas(run, "draw long, mean double")


def sign_flips(rows: DataFrame, unit: str, value: str, n_draws: int, salt: str = "p") -> DataFrame:
    """STAT7: two-sided sign-flip permutation of unit sums: (n_units, observed, p).

    Each task adds up its own units under every draw, so a row a draw is all that it sends.
    """
    units = numbered_units(rows, unit, value)
    flips = units.select("unit_at", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    signed = flips.select("draw", "n", (F.col("s") * F.when(pick(F.col("draw"), F.col("unit_at"), 2, salt) == 1, 1).otherwise(-1)).alias("v"))
    draws = signed.groupBy("draw").agg((F.sum("v") / F.sum("n")).alias("m"))
    observed = units.agg(F.count("*").alias("n_units"), (F.sum("s") / F.sum("n")).alias("observed"))
    return draws.crossJoin(F.broadcast(observed)).groupBy("n_units", "observed").agg(((F.count_if(F.abs("m") >= F.abs("observed") - 1e-15) + 1) / (F.lit(n_draws) + 1)).alias("p"))


def adjusted(tests: DataFrame, p: str = "p", name: str = "test") -> DataFrame:
    """STAT8, STAT9: Holm and Benjamini-Hochberg over one family (all rows)."""
    m = tests.count()
    rows = numbered(tests, [p, name], "rank").withColumn("rank", F.col("rank") + 1)
    rows = running(rows, ["rank"], (F.lit(m) - F.col("rank") + 1) * F.col(p), "p_holm", "max").withColumn("back", -F.col("rank"))
    rows = running(rows, ["back"], F.lit(m) * F.col(p) / F.col("rank"), "p_bh", "min")
    return rows.withColumns({c: F.least(F.lit(1.0), F.col(c)) for c in ("p_holm", "p_bh")}).drop("rank", "back")


def signed_rank_p(values: np.ndarray) -> float:
    """STAT10: two-sided Wilcoxon signed-rank: exact for 50 or fewer values without ties or zeros, else normal."""
    x = np.asarray(values, float)
    dropped, x = (x == 0).any(), x[x != 0]
    n = len(x)
    if not n:
        return 1.0
    rank = pd.Series(np.abs(x)).rank().to_numpy()
    t = min(rank[x > 0].sum(), rank[x < 0].sum())
    ties = np.unique(np.abs(x), return_counts=True)[1]
    if n <= 50 and not dropped and (ties == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return float(min(1.0, 2 * ways[: int(t) + 1].sum() / 2**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    return math.erfc(abs(t - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def sign_tests(rows: DataFrame, by: str, value: str) -> DataFrame:
    """STAT11: positives, informative values and exact two-sided binomial p of each class.

    The p of a class is a function of two counts, so only these leave the JVM, a row a class.
    """
    counts = rows.groupBy(by).agg(F.count_if(F.col(value) > 0).alias("k"), F.count_if(F.col(value) != 0).alias("n"))
    return counts.withColumn("p", F.pandas_udf(lambda k, n: pd.Series([sign_test_p(int(a), int(b)) for a, b in zip(k, n)]), "double")("k", "n"))


def signed_rank_tests(rows: DataFrame, by: str, value: str) -> DataFrame:
    """STAT10: (by, n, w_plus, w_minus, z, p), the two-sided Wilcoxon signed-rank test of each class.

    Ranks are averaged over ties and found over groups of equal magnitude; zeros are dropped. p is exact for 50
    or fewer values without ties or zeros: the number of sign patterns of each rank sum is built up rank by rank,
    as an array. Otherwise it comes from the normal approximation z. A class of zeros only has p = 1.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    mags = known.groupBy(by, F.abs(value).alias("a")).agg(F.count("*").alias("k"), F.count_if(F.col(value) > 0).alias("up")).withColumn("k", F.when(F.col("a") > 0, F.col("k")).otherwise(-F.col("k")))
    upto = F.sum(F.greatest("k", F.lit(0))).over(Window.partitionBy(by).orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    ranked = mags.withColumn("rank", upto - (F.col("k") - 1) / 2)
    own = lambda c: F.sum(F.when(F.col("k") > 0, c).otherwise(0))
    sums = ranked.groupBy(by).agg(own(F.col("k")).alias("n"), own(F.col("rank") * F.col("up")).alias("w_plus"), own(F.col("rank") * (F.col("k") - F.col("up"))).alias("w_minus"), own(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"), F.min("k").alias("least"))
    n, t = F.col("n"), F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    exact = (F.col("least") > 0) & (F.col("ties") == 0) & (n <= 50)
    step = lambda ways, k: F.transform(ways, lambda w, i: w + F.when(i >= k, F.get(ways, i - k)).otherwise(0.0))
    none = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(n * (n + 1) / 2)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), n), none, step)
    tail = F.aggregate(F.slice(ways, 1, F.floor(t).cast("int") + 1), F.lit(0.0), lambda a, w: a + w)
    wide = sums.withColumn("z", F.when(spread > 0, (t - n * (n + 1) / 4) / spread)).withColumn("tail", F.when(exact & (n > 0), 2 * tail / F.pow(F.lit(2.0), n)))
    normal = F.pandas_udf(lambda z: z.map(lambda x: math.erfc(abs(x) / math.sqrt(2))), "double")  # a row a class
    return wide.select(by, "n", "w_plus", "w_minus", "z", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("tail", normal(F.coalesce("z", F.lit(0.0)))))).alias("p"))


def sign_test_p(k: int, n: int) -> float:
    """STAT11: exact two-sided binomial at one half; the terms are added as logarithms, so n may be large."""
    if n == 0 or 2 * k == n:
        return 1.0
    i = np.arange(min(k, n - k))
    terms = np.concatenate(([0.0], np.cumsum(np.log(n - i) - np.log(i + 1)))) - n * math.log(2)
    return min(1.0, 2 * float(np.exp(terms).sum()))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """STAT12: correlation of average ranks; ranks are summed over value groups, not over rows."""

    def ranks(c: str) -> DataFrame:
        groups = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(c).agg(F.count("*").alias("k"))
        return running(groups, [c], F.col("k"), "upto").select(c, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"rank_{c}"))

    return rows.join(ranks(a), a).join(ranks(b), b).agg(F.count("*").alias("n"), F.corr(f"rank_{a}", f"rank_{b}").alias("rho"))


def quintiles(rows: DataFrame, by: str, value: str, parts: int = 5) -> DataFrame:
    """AGG27: right-closed bins at the exact quantiles of ``by``; the least value is in the first."""
    ends = [f"q{i}" for i in range(parts + 1)]
    edges = quantiles(rows, by, {q: i / parts for i, q in enumerate(ends)}).select(F.array_distinct(F.array(*ends)).alias("q"))
    at = F.greatest(F.size(F.filter("q", lambda e: e < F.col(by))), F.lit(1)) - 1
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.avg(by).alias(f"mean_{by}"), F.avg(value).alias(f"mean_{value}"))


def class_summary(rows: DataFrame, by: list[str], value: str, unit: str, n_draws: int = 0, salt: str = "class") -> DataFrame:
    """AGG21: sites, units, mean and share of zeros of each class and, with draws, the interval of its mean over resampled units.

    Classes are resampled together; one without a known unit and value has no interval.
    """
    out = rows.groupBy(*by).agg(F.count("*").alias("n_sites"), F.countDistinct(unit).alias("n_proteins"), F.avg(value).alias("mean"), F.avg((F.col(value) == 0).cast("double")).alias("share_zero"))
    if not n_draws:
        return out
    return out.join(interval(bootstrap_by(rows, by, unit, value, n_draws, salt), by=tuple(by)), by, "left")


def against_baseline(summary: DataFrame, by: str, baseline: str) -> DataFrame:
    """AGG22: the baseline class's mean less each class's."""
    base = summary.where(F.col(by) == baseline).select(F.col("mean").alias("base_mean"))
    return summary.crossJoin(F.broadcast(base)).select(by, (F.col("base_mean") - F.col("mean")).alias("difference"))  # one row


def paired_summary(rows: DataFrame, a: str, b: str) -> DataFrame:
    """JN14, AGG23: pairs, informative and tied ones, means of both sides and of their difference."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(a) != F.col(b)).alias("n_informative"), F.count_if(F.col(a) == F.col(b)).alias("n_tied"), F.avg(a).alias("mean_case"), F.avg(b).alias("mean_control"), F.avg(F.col(a) - F.col(b)).alias("mean_difference"))


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """AGG24: sweep (seed, n_pairs, mean, ci_low, ci_high) over seeds."""
    excludes = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    one = sweep.agg(F.count("*").alias("n_seeds"), F.min("n_pairs").alias("min_pairs"), F.max("n_pairs").alias("max_pairs"), F.min("mean").alias("min_mean"), F.max("mean").alias("max_mean"), F.bool_and(F.col("mean") > 0).alias("all_positive"), F.avg(excludes.cast("double")).alias("share_excluding_zero"))
    return one.crossJoin(F.broadcast(quantiles(sweep, "mean", {"median_mean": 0.5})))  # one row each


def convergence(rows: DataFrame, a: str, b: str, sd: Column) -> DataFrame:
    """AGG25, STAT17: how far two scores agree, and whether the cheaper is adopted."""
    gap = F.abs(F.col(a) - F.col(b)) / sd
    gaps = quantiles(rows, gap, {"median_gap": 0.5, "p95_gap": 0.95})
    out = gaps.crossJoin(F.broadcast(rows.agg(F.corr(a, b).alias("correlation"))))  # one row each
    return out.withColumn("adopt", (F.col("median_gap") < 0.02) & (F.col("p95_gap") < 0.05) & (F.col("correlation") > 0.99))


def sensitivity(parts: dict[str, DataFrame], unit: str, value: str, n_draws: int, margin: float) -> DataFrame:
    """STAT18: interval and verdict for each labelled selection of rows."""
    one = lambda label, rows: interval(bootstrap_draws(rows, unit, value, n_draws, label)).crossJoin(rows.agg(F.avg(value).alias("mean"), F.count("*").alias("n"))).select(F.lit(label).alias("label"), "n", "mean", "ci_low", "ci_high", verdict(F.col("ci_low"), F.col("ci_high"), F.lit(margin)).alias("verdict"))
    return reduce(DataFrame.unionAll, [one(k, r) for k, r in parts.items()])


def seeded_sample(rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """STAT16: n rows chosen by a seeded digest of the key; the same for any partitioning and in any engine with md5."""
    return rows.orderBy(seeded(seed, *keys), *keys).limit(n)
