"""Cases matched to controls: scaling, caliper edges, greedy and optimal pairs, balance."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from hashlib import md5
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siteloom.functions.exprs import half_even
from siteloom.operators.graph import components, cut

SIDE = ("accession", "position")
PAIR = "case_accession string, case_position int, control_accession string, control_position int, distance double, match_rank int"


def usable(rows: DataFrame, features: list[str], exact: list[str]) -> DataFrame:
    """FLT10: rows with every feature known (NaN is unknown) and every exact column set."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features] + [F.col(c).isNotNull() for c in exact]))


def scales(cases: DataFrame, controls: DataFrame, features: list[str]) -> dict[str, float]:
    """FN37: pooled sample standard deviation of each feature; 1 where it is zero or unknown."""
    row = cases.select(*features).unionAll(controls.select(*features)).agg(*(F.stddev_samp(c).alias(c) for c in features)).first()
    return {c: row[c] if row[c] and not math.isnan(row[c]) else 1.0 for c in features}


def caliper_edges(cases: DataFrame, controls: DataFrame, features: list[str], caliper: float = 0.25, exact: tuple[str, ...] = ()) -> DataFrame:
    """JN12: all pairs equal in the exact columns and within the caliper in scaled distance.

    Scaled features are cut into cells of caliper width; a case goes to its own and all adjacent cells, so
    the join is an equality on exact columns and cell, never a cross product. Differences are scaled, not
    values, so that equal differences are equal distances.
    """
    a, b, scale = _points(cases, controls, features, list(exact))
    return _within(a, b, list(exact), scale, caliper).select("case_accession", "case_position", "control_accession", "control_position", *exact, "distance")


def _points(cases: DataFrame, controls: DataFrame, features: list[str], exact: list[str], carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[float]]:
    """Usable cases and controls with their features as x0, x1, ..., and the scales of these; ``carried`` are columns to keep."""
    cases, controls = usable(cases, features, exact), usable(controls, features, exact)
    found = scales(cases, controls, features)
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    a, b = (rows.select(*(F.col(c).alias(f"{side}_{c}") for c in SIDE), *exact, *x, *carried) for side, rows in (("case", cases), ("control", controls)))
    return a, b, [found[c] for c in features]


def _cells(scale: list[float], radius: float) -> list[Column]:
    """The cell of a point: a little wider than the radius, as quotients are rounded."""
    width = (radius if radius > 0 else 1.0) * (1 + 1e-9)
    return [F.floor(F.col(f"x{i}") / s / width).cast("long") for i, s in enumerate(scale)]


def _around(cell: list[Column]) -> Column:
    """A cell and all adjacent ones, a row each."""
    return F.explode(F.array(*(F.struct(*((c + d).alias(f"c{i}") for i, (c, d) in enumerate(zip(cell, step)))) for step in product((-1, 0, 1), repeat=len(cell)))))


def _within(a: DataFrame, b: DataFrame, exact: list[str], scale: list[float], radius: float) -> DataFrame:
    """Rows of a with those of b at the radius or less; b's points are y0, y1, ..."""
    cell, names = _cells(scale, radius), [f"c{i}" for i in range(len(scale))]
    b = b.withColumns(dict(zip(names, cell))).withColumnsRenamed({f"x{i}": f"y{i}" for i in range(len(scale))})
    a = a.withColumn("cell", _around(cell)).select("*", "cell.*").drop("cell")
    near = a.hint("merge").join(b, [*exact, *names])  # a's rows are many more than Spark's estimate says
    distance = F.sqrt(sum((F.pow((F.col(f"x{i}") - F.col(f"y{i}")) / s, 2) for i, s in enumerate(scale)), F.lit(0.0)))
    return near.withColumn("distance", distance).where(F.col("distance") <= radius).drop(*names)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """SRT3: the k nearest controls of each case, ties by key."""
    order = Window.partitionBy("case_accession", "case_position").orderBy("distance", "control_accession", "control_position")
    return edges.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= k)


def nearest_controls(cases: DataFrame, controls: DataFrame, features: list[str], caliper: float = 0.25, exact: tuple[str, ...] = (), k: int = 3) -> DataFrame:
    """SRT3: nearest(caliper_edges(...), k) without all the edges, whose number grows with the square of a crowd.

    Cases at one point have the same neighbours, so points are looked up and not cases; of the controls at one
    point only the k of least key can count. The radius starts where a cell holds few points and doubles up to
    the caliper: a point with k controls within the radius is settled, as all others are farther.
    """
    exact = list(exact)
    a, b, scale = _points(cases, controls, features, exact)
    point = [*exact, *(f"x{i}" for i in range(len(scale)))]
    own = Window.partitionBy(*point).orderBy("control_accession", "control_position")
    b = cut(b.withColumn("at", F.row_number().over(own)).where(F.col("at") <= k).drop("at"))
    left = cut(a.select(*point).distinct())
    cells = _cells(scale, caliper)
    crowd = b.groupBy(*exact, *cells).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    radius, done = caliper / 2 ** max(0, math.ceil(math.log2(max(1.0, crowd / (2 * k))) / len(scale))), []
    order = Window.partitionBy(*point).orderBy("distance", "control_accession", "control_position")
    while True:
        near = _within(left, b, exact, scale, radius).select(*point, "control_accession", "control_position", "distance")
        best = cut(near.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= k))
        if radius >= caliper:
            done.append(best)
            break
        settled = best.where(F.col("match_rank") == k).select(*point)
        done.append(best.join(settled, point, "left_semi"))
        left, radius = cut(left.join(settled, point, "left_anti")), min(caliper, 2 * radius)
    found = reduce(DataFrame.unionByName, done)
    return a.join(found, point).select("case_accession", "case_position", "control_accession", "control_position", *exact, "distance", "match_rank")


def _areas(a: DataFrame, b: DataFrame, exact: list[str], scale: list[float], caliper: float) -> tuple[DataFrame, DataFrame]:
    """Cases and controls with ``area``: of those that meet in cells next to each other, directly or through others, it is the same.

    An area is one or more components of the caliper graph, found from its occupied cells and not from its edges.
    """
    names, cell = [f"c{i}" for i in range(len(scale))], _cells(scale, caliper)
    a, b = (rows.withColumns(dict(zip(names, cell))) for rows in (a, b))
    name = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in (*exact, *names)))
    held = cut(a.select(*exact, *names).unionAll(b.select(*exact, *names)).distinct().withColumn("node", name))
    around = held.select(F.col("node").alias("a"), *exact, _around([F.col(c) for c in names]).alias("cell")).select("a", *exact, "cell.*")
    found = cut(components(around.join(held.withColumnRenamed("node", "b"), [*exact, *names]).select("a", "b")))
    return tuple(rows.withColumn("node", name).join(found.withColumnRenamed("component", "area"), "node").drop("node", *names) for rows in (a, b))


#: Most cases and controls of an area that a task matches in turn, and about how many rows a task gets; most pairs of
#: a case and a control of which an optimal matching holds the costs in one task.
AREA, DEALT, COSTS = 200_000, 50_000, 25_000_000


def _dealt(a: DataFrame, b: DataFrame, able: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, a, b): both sides of the areas that ``able`` (over n_cases and n_controls) holds for, with the group that works on them; the others."""
    sizes = a.groupBy("area").agg(F.count("*").alias("n_cases")).join(b.groupBy("area").agg(F.count("*").alias("n_controls")), "area")
    sizes = cut(sizes.withColumn("able", able))
    total = sizes.where("able").agg(F.sum(F.col("n_cases") + F.col("n_controls"))).first()[0] or 0
    groups = max(1, -(-total // DEALT))
    side = lambda rows, s: rows.select(F.lit(s).alias("side"), F.col(f"{s}_accession").alias("accession"), F.col(f"{s}_position").alias("position"), *(c for c in rows.columns if not c.startswith(s)))
    rows = side(a, "case").unionAll(side(b, "control")).join(sizes.where("able").select("area"), "area").withColumn("of", F.pmod(F.xxhash64("area"), F.lit(groups)))
    large = sizes.where("not able").select("area")
    return rows, *(x.join(large, "area", "left_semi").drop("area") for x in (a, b))


def _sides(pdf: pd.DataFrame, x: list[str]) -> tuple[list[tuple], np.ndarray, list[tuple], np.ndarray]:
    """Keys and points of the cases, in the order given, and of the controls, in order of key."""
    a, b = pdf[pdf.side == "case"], pdf[pdf.side == "control"].sort_values(["accession", "position"])
    keys = lambda rows: list(zip(rows.accession, rows.position))
    return keys(a), a[x].to_numpy(float), keys(b), b[x].to_numpy(float)


#: Control points within the caliper of a case's point that a task keeps, over all points of an area.
KEPT = 500_000


def _walker(at: np.ndarray, own: np.ndarray, scale: np.ndarray, caliper: float) -> Callable[[np.ndarray, int], list[tuple[int, int, float, int]]]:
    """Cases at ``at``, controls at ``own`` in order of key -> a walk: (turns, k) -> (case, control, distance, rank) of the k nearest that are still free.

    The first number of a case or control is its area, the others are its point. Controls at one point go in order of key,
    so a point is a queue; points are looked up by cells of caliper width. What lies around a case's point is looked up
    once and serves all walks, as long as there are KEPT points in all; beyond, it is looked up for every case.
    """
    points, which = np.unique(own, axis=0, return_inverse=True)
    queue = np.argsort(which.ravel(), kind="stable")
    start = np.searchsorted(which.ravel()[queue], np.arange(len(points)))
    end, width = np.append(start[1:], len(queue)), scale * (caliper if caliper > 0 else 1.0) * (1 + 1e-9)
    cell = lambda x: np.column_stack([x[:, 0], np.floor(x[:, 1:] / width)])
    cells, cell_of = np.unique(cell(points), axis=0, return_inverse=True)
    dealt = np.argsort(cell_of.ravel(), kind="stable")
    places = dict(zip(map(tuple, cells.tolist()), np.split(dealt, np.searchsorted(cell_of.ravel()[dealt], np.arange(1, len(cells))))))
    spots, spot = np.unique(at, axis=0, return_inverse=True)
    homes, spot_of, steps = cell(spots).tolist(), spot.ravel().tolist(), list(product((-1, 0, 1), repeat=len(scale)))
    kept: dict[int, list[tuple[float, list[int]]]] = {}
    controls, last, room = queue.tolist(), end.tolist(), KEPT

    def around(j: int, near_by: dict[tuple, np.ndarray], head: np.ndarray | None) -> list[tuple[float, list[int]]]:
        """Points within the caliper of a case's, from near to far, those at one distance together; with ``head``, only points that aren't used up."""
        area, *home = homes[j]
        found = []
        for step in steps:
            key = (area, *(h + d for h, d in zip(home, step)))
            mine = near_by.get(key)
            if mine is not None and head is not None:
                free = mine[head[mine] < end[mine]]
                if 2 * len(free) < len(mine):  # what is used up is looked at no more
                    near_by[key] = free
                mine = free
            if mine is not None and len(mine):
                found.append(mine)
        if not found:
            return []
        near, x = np.concatenate(found), spots[j, 1:]
        gap = np.sqrt((((x - points[near, 1:]) / scale) ** 2).sum(axis=1)) if len(scale) > 2 else np.sqrt(sum(((x[d] - points[near, d + 1]) / s) ** 2 for d, s in enumerate(scale)))
        near, gap = near[gap <= caliper], gap[gap <= caliper]
        order, out = np.argsort(gap, kind="stable"), []
        for g, p in zip(gap[order].tolist(), near[order].tolist()):
            if out and out[-1][0] == g:
                out[-1][1].append(p)
            else:
                out.append((g, [p]))
        return out

    def walk(turns: np.ndarray, k: int) -> list[tuple[int, int, float, int]]:
        nonlocal room
        head, used, near_by, out = start.tolist(), [0] * len(spots), dict(places), []
        heads = start.copy()
        for i in turns.tolist():
            j = spot_of[i]
            near = kept.get(j)
            if near is None and room > 0:
                near = kept[j] = around(j, places, None)
                room -= 1 + sum(len(p) for _, p in near)
            # a distance whose points are used up stays so for the rest of this walk
            n, rank = (0, 1) if near is None else (used[j], 1)
            mine = around(j, near_by, heads) if near is None else near
            while n < len(mine) and rank <= k:
                gap, tied = mine[n]
                free = [p for p in tied if head[p] < last[p]]
                if not free:
                    n += 1
                    continue
                p = free[0] if len(free) == 1 else min(free, key=lambda q: controls[head[q]])
                out.append((i, controls[head[p]], gap, rank))
                head[p] += 1
                heads[p] += 1
                rank += 1
            if near is not None:
                used[j] = n
        return out

    return walk


def _turns(seed: int, cases: list[tuple]) -> np.ndarray:
    """Cases, given in order of key, in the order of the md5 of seed and key."""
    digest = np.frombuffer(b"".join(md5(f"{seed}-{a}-{p}".encode()).digest() for a, p in cases), ">u8").reshape(-1, 2)
    return np.lexsort((digest[:, 1], digest[:, 0]))


#: Most seeds that a task walks with: their pairs are held until the task ends.
TOGETHER = 20


def _walked(a: DataFrame, b: DataFrame, scale: list[float], caliper: float, k: int, seeds: tuple[int, ...], emit: Callable, schema: str, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``emit`` makes of the greedy pairs of areas under seeds, as rows of ``schema``; cases and controls of areas beyond AREA.

    emit(cases, controls, seed, case, control, distance, rank) gets both sides in order of key and arrays of the pairs. A task gets
    areas with some of the seeds, so that what lies around a point is looked up once for these, and rows are sent a few times.
    """
    rows, far_a, far_b = _dealt(a, b, F.col("n_cases") + F.col("n_controls") <= AREA)
    spark, x, own = a.sparkSession, [f"x{i}" for i in range(len(scale))], np.array(scale)
    rows = cut(rows.select("of", "side", "accession", "position", "area", *x, *carried))
    groups = rows.select("of").distinct().count()
    shares = max(1, -(-len(seeds) // TOGETHER), min(len(seeds), -(-4 * spark.sparkContext.defaultParallelism // max(1, groups))))
    every = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    # dealt by number: rows are few bytes beside the work on them
    every = every.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "of", "share")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, pdf = seeds[int(pdf.share.iloc[0]) :: shares], pdf.sort_values(["accession", "position"])
        pdf["area"] = pd.factorize(pdf.area)[0]
        cases, controls = (pdf[pdf.side == s].reset_index(drop=True) for s in ("case", "control"))
        walk = _walker(cases[["area", *x]].to_numpy(float), controls[["area", *x]].to_numpy(float), own, caliper)
        keys, found = list(zip(cases.accession, cases.position)), []
        for seed in mine:
            pairs = walk(_turns(seed, keys), k)
            found.append([np.full(len(pairs), seed), *(np.array(c, t) for c, t in zip(zip(*pairs) if pairs else ([],) * 4, (int, int, float, int)))])
        return emit(cases, controls, *(np.concatenate(c) for c in zip(*found)))

    return every.groupBy("of", "share").applyInPandas(work, schema), far_a, far_b


def _pairs(cases: pd.DataFrame, controls: pd.DataFrame, seed: np.ndarray, i: np.ndarray, j: np.ndarray, gap: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
    side = lambda rows, s, at: {f"{s}_{c}": rows[c].to_numpy()[at] for c in SIDE}
    return pd.DataFrame({"seed": seed, **side(cases, "case", i), **side(controls, "control", j), "distance": gap, "match_rank": rank})


def _contrasts(cases: pd.DataFrame, controls: pd.DataFrame, seed: np.ndarray, i: np.ndarray, j: np.ndarray, gap: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
    own, other = cases.score.to_numpy(float)[i], controls.score.to_numpy(float)[j]
    known = ~np.isnan(own) & ~np.isnan(other)
    seed, i, own, other = seed[known], i[known], own[known], other[known]
    first = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (i[1:] != i[:-1]))[: len(i)])  # a case's controls follow each other
    mean = np.add.reduceat(other, first) / np.diff(np.append(first, len(i))) if len(first) else other
    return pd.DataFrame({"seed": seed[first], "unit_at": cases.unit_at.to_numpy()[i[first]].astype(np.int64), "contrast": own[first] - mean})


def greedy_controls(cases: DataFrame, controls: DataFrame, features: list[str], caliper: float = 0.25, exact: tuple[str, ...] = (), k: int = 5, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """STAT13, STAT15: seed_sweep(caliper_edges(...), seeds, k) without the edges, whose number grows with the square of a crowd.

    Areas of at most AREA cases and controls are walked through in turn, several in a task, on points; the edges
    of larger areas go through the rounds.
    """
    a, b, scale = _points(cases, controls, features, list(exact))
    a, b = _areas(a, b, list(exact), scale, caliper)
    pairs, far_a, far_b = _walked(a, b, scale, caliper, k, seeds, _pairs, "seed int, " + PAIR)
    pairs = cut(pairs.withColumn("distance", half_even(F.col("distance"), 4)))
    if far_a.isEmpty():
        return pairs
    return pairs.unionByName(_far(far_a, far_b, list(exact), scale, caliper, k, seeds))


def greedy_contrasts(cases: DataFrame, controls: DataFrame, features: list[str], caliper: float, exact: tuple[str, ...], k: int, seeds: tuple[int, ...]) -> DataFrame:
    """STAT13 to AGG17: (seed, unit_at, contrast) of greedy_controls, a row a case with a score and a scored control.

    Both sides carry their score, and cases the number unit_at, so that neither pairs nor names go any farther than the task that finds them.
    """
    carried = ("score", "unit_at")
    a, b, scale = _points(cases, controls.withColumn("unit_at", F.lit(None).cast("long")), features, list(exact), carried)
    a, b = _areas(a, b, list(exact), scale, caliper)
    near, far_a, far_b = _walked(a, b, scale, caliper, k, seeds, _contrasts, "seed int, unit_at long, contrast double", carried)
    if far_a.isEmpty():
        return near
    pairs = _far(far_a, far_b, list(exact), scale, caliper, k, seeds)
    own = far_a.select("case_accession", "case_position", "unit_at", F.col("score").alias("case_score"))
    other = far_b.select("control_accession", "control_position", F.col("score").alias("control_score"))
    scored = pairs.join(own, ["case_accession", "case_position"]).join(other, ["control_accession", "control_position"]).where("case_score is not null and control_score is not null")
    return near.unionByName(scored.groupBy("seed", "unit_at").agg((F.first("case_score") - F.avg("control_score")).alias("contrast")))


def _far(a: DataFrame, b: DataFrame, exact: list[str], scale: list[float], caliper: float, k: int, seeds: tuple[int, ...]) -> DataFrame:
    """Greedy pairs by rounds over the edges."""
    edges = _within(a, b, exact, scale, caliper)
    return _rounds(edges.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))), k)


def _blocks(edges: DataFrame) -> DataFrame:
    """Edges with their component: no choice in one component bears on another."""
    name = lambda side: F.concat_ws("\x1f", F.lit(side), f"{side}_accession", f"{side}_position")
    found = components(edges.select(name("case").alias("a"), name("control").alias("b")))
    return edges.withColumn("node", name("case")).join(found, "node").drop("node")


def greedy_pairs(edges: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """STAT13: cases in a seeded order each take their k nearest controls still free.

    The order is the md5 of seed and key, the same for any partitioning and in other engines. Taking turns
    gives the one stable matching of cases that like near controls and controls that like early cases, so
    it is found in rounds: every case asks for the k nearest it may still get, and where an earlier case
    asks for a control, later ones lose it. A round is two grouped passes over the edges that are left.
    Cases that like the same controls in the same order settle one a round, so after PATIENCE rounds the
    components of at most SMALL edges are finished in turn, many in a task; only larger ones go on.
    """
    return _rounds(edges.withColumn("seed", F.lit(seed)), k).drop("seed")


#: rounds between looks at the components, and the most edges of one that a task finishes
PATIENCE, SMALL = 8, 100_000


def _finished(left: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the components with SMALL edges or fewer, and the edges of the others.

    Edges that earlier rounds took away can't be missed: somebody earlier has their control. A group of
    components holds about SMALL edges.
    """
    key = ["seed", "case_accession", "case_position", "control_accession", "control_position"]
    name = lambda side: F.concat_ws("\x1f", F.col("seed").cast("string"), F.lit(side), f"{side}_accession", f"{side}_position")
    found = components(left.select(name("case").alias("a"), name("control").alias("b")))
    rows = cut(left.withColumn("node", name("case")).join(found, "node").drop("node"))
    rows = rows.join(rows.groupBy("component").agg(F.count("*").alias("n_edges")), "component")
    small = cut(rows.where(F.col("n_edges") <= SMALL).select(*key, "distance", F.col("turn.turn").alias("turn"), "component"))
    groups = max(1, -(-small.count() // SMALL))
    columns = [*key, "distance"]

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, had, out = set(), {}, []
        order = pdf.sort_values(["seed", "turn", "case_accession", "case_position", "distance", "control_accession", "control_position"])
        for row in order[columns].itertuples(index=False, name=None):
            case, control = row[:3], (row[0], *row[3:5])
            if had.get(case, 0) < k and control not in taken:
                taken.add(control)
                had[case] = had.get(case, 0) + 1
                out.append((*row, had[case]))
        return pd.DataFrame(out, columns=[*columns, "match_rank"])

    schema = StructType([*small.select(*columns).schema.fields, StructField("match_rank", IntegerType())])
    pairs = small.groupBy(F.pmod(F.xxhash64("component"), F.lit(groups))).applyInPandas(turns, schema)
    return cut(pairs), cut(rows.where(F.col("n_edges") > SMALL).select(*left.columns))


def _rounds(edges: DataFrame, k: int) -> DataFrame:
    """Greedy pairs for each value of the column seed."""
    turn = F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in ("seed", "case_accession", "case_position"))))
    case, control = ["seed", "case_accession", "case_position"], ["seed", "control_accession", "control_position"]
    left = cut(edges.select(*case, *control[1:], "distance", F.struct(turn.alias("turn"), "case_accession", "case_position").alias("turn")))
    near = Window.partitionBy(*case).orderBy("distance", "control_accession", "control_position")
    n, rounds, done = left.count(), 0, []
    while True:
        asked = left.withColumn("match_rank", F.row_number().over(near))
        first = F.min(F.when(F.col("match_rank") <= k, F.col("turn"))).over(Window.partitionBy(*control))
        after = cut(asked.withColumn("first", first).where(F.col("first").isNull() | (F.col("turn") <= F.col("first"))).drop("first"))
        n, before = after.count(), n
        if n == before:
            done.append(after.where(F.col("match_rank") <= k))
            break
        left, rounds = after.drop("match_rank"), rounds + 1
        if rounds % PATIENCE == 0:
            pairs, left = _finished(left, k)
            done.append(pairs)
            n = left.count()
    found = [d.select(*case, *control[1:], half_even(F.col("distance"), 4).alias("distance"), F.col("match_rank").cast("int").alias("match_rank")) for d in done]
    return reduce(lambda a, b: a.unionByName(b), found)


def optimal_pairs(edges: DataFrame) -> DataFrame:
    """STAT14: one control a case, as many pairs as can be, then least total distance.

    Each component of the edge graph is solved in a task of its own.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a = sorted(set(zip(pdf.case_accession, pdf.case_position)))
        b = sorted(set(zip(pdf.control_accession, pdf.control_position)))
        ia, ib = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
        costs = {(ia[ca, cp], ib[ta, tp]): d for ca, cp, ta, tp, d in zip(pdf.case_accession, pdf.case_position, pdf.control_accession, pdf.control_position, pdf.distance)}
        got = min_cost_matching(costs, len(a), len(b))
        return pd.DataFrame([(*a[i], *b[j], round(costs[i, j], 4), 1) for i, j in sorted(got.items())], columns=["case_accession", "case_position", "control_accession", "control_position", "distance", "match_rank"])

    return _blocks(edges).groupBy("component").applyInPandas(solve, PAIR)


def optimal_controls(cases: DataFrame, controls: DataFrame, features: list[str], caliper: float = 0.25, exact: tuple[str, ...] = ()) -> DataFrame:
    """STAT14: what optimal_pairs(caliper_edges(...)) maximises and minimises, with the exact columns and distances in full.

    Areas of at most COSTS pairs are solved in tasks, several in one, on points; no edges are made of them. The
    edges of larger ones go to optimal_pairs.
    """
    exact = list(exact)
    a, b, scale = _points(cases, controls, features, exact)
    a, b = _areas(a, b, exact, scale, caliper)
    rows, far_a, far_b = _dealt(a, b, F.col("n_cases") * F.col("n_controls") <= COSTS)
    x = [f"x{i}" for i in range(len(scale))]
    # a group of its own for each area: areas are worked on for much longer than they are moved
    kinds = ", ".join(f"{c} {t}" for c, t in a.select(*exact).dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, at, b, points = _sides(pdf, x)
        gap = np.zeros((len(a), len(b)))
        for i, s in enumerate(scale):
            gap += ((at[:, i, None] - points[None, :, i]) / s) ** 2
        np.sqrt(gap, out=gap)
        same = [pdf[c].iloc[0] for c in exact]
        got = [(*a[i], *b[j], float(gap[i, j]), *same) for i, j in assigned(np.where(gap <= caliper, gap, np.inf))]
        return pd.DataFrame(got, columns=["case_accession", "case_position", "control_accession", "control_position", "distance", *exact])

    schema = "case_accession string, case_position int, control_accession string, control_position int, distance double" + ", " * bool(exact) + kinds
    pairs = cut(rows.groupBy("area").applyInPandas(solve, schema))
    if far_a.isEmpty():
        return pairs
    edges = cut(_within(far_a, far_b, exact, scale, caliper))
    key = ["case_accession", "case_position", "control_accession", "control_position"]
    return pairs.unionByName(edges.select(*key, "distance", *exact).join(optimal_pairs(edges).select(*key), key))


def assigned(costs: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of as many finite costs as can be, of least total: shortest augmenting paths with potentials.

    A pair that isn't allowed costs more than all others together, so as few of them as can be are taken.
    """
    if costs.shape[0] > costs.shape[1]:
        return [(i, j) for j, i in assigned(np.ascontiguousarray(costs.T))]
    n, m = costs.shape
    able = np.isfinite(costs)
    if not able.any():
        return []
    costs = np.where(able, costs, 1.0 + n * float(costs[able].max()))
    u = costs.min(axis=1)
    v = np.minimum((costs - u[:, None]).min(axis=0), 0.0)
    column, row = np.full(n, -1), np.full(m, -1)
    for i in range(n):  # what is cheapest for a row and still free
        free = np.flatnonzero((costs[i] - u[i] - v <= 0) & (row < 0))
        if len(free):
            column[i], row[free[0]] = free[0], i
    for start in np.flatnonzero(column < 0):
        reach, came, open_ = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
        i, low, seen = start, 0.0, []
        while True:
            way = low + costs[i] - u[i] - v
            better = open_ & (way < reach)
            reach[better], came[better] = way[better], i
            left = np.where(open_, reach, np.inf)
            low = left.min()
            ends = np.flatnonzero(left == low)
            ended = ends[row[ends] < 0]
            j = int(ended[0] if len(ended) else ends[0])
            open_[j] = False
            if row[j] < 0:
                break
            i = row[j]
            seen.append((i, j))
        u[start] += low
        for i, c in seen:
            u[i] += low - reach[c]
        done = np.flatnonzero(~open_)
        v[done] -= low - reach[done]
        while True:
            i = came[j]
            row[j], column[i], j = i, j, column[i]
            if i == start:
                break
    return [(i, int(j)) for i, j in enumerate(column) if able[i, j]]


def min_cost_matching(costs: dict[tuple[int, int], float], n: int, m: int) -> dict[int, int]:
    """Successive cheapest augmenting paths: after each, the matching is the cheapest of its size."""
    near: dict[int, list[tuple[int, float]]] = {}
    for (i, j), c in sorted(costs.items()):
        near.setdefault(i, []).append((j, c))
    mate_a: dict[int, int] = {}
    mate_b: dict[int, int] = {}
    while True:
        # queue-based Bellman-Ford in the residual graph: matched edges run back at minus their cost
        dist = {i: 0.0 for i in near if i not in mate_a}
        reach: dict[int, float] = {}
        came: dict[int, int] = {}
        queue = list(dist)
        while queue:
            follow = []
            for i in queue:
                for j, c in near[i]:
                    if mate_a.get(i) != j and dist[i] + c < reach.get(j, math.inf) - 1e-12:
                        reach[j], came[j] = dist[i] + c, i
                        k = mate_b.get(j)
                        if k is not None and reach[j] - costs[k, j] < dist.get(k, math.inf) - 1e-12:
                            dist[k] = reach[j] - costs[k, j]
                            follow.append(k)
            queue = follow
        ends = [(d, j) for j, d in reach.items() if j not in mate_b]
        if not ends:
            return mate_a
        j = min(ends)[1]
        while True:
            i = came[j]
            before = mate_a.get(i)
            mate_a[i], mate_b[j] = j, i
            if before is None:
                break
            j = before


def smd(case_mean: Column, control_mean: Column, case_var: Column, control_var: Column, case_n: Column, control_n: Column) -> Column:
    """AGG13: difference of means over the pooled spread; null under two values, 0 without spread."""
    pooled = F.sqrt((case_var + control_var) / 2)
    return F.when((case_n < 2) | (control_n < 2), None).when(pooled == 0, 0.0).otherwise((case_mean - control_mean) / pooled)


def balance(groups: DataFrame, features: list[str], flag: str = "is_case", weight: str | None = None) -> DataFrame:
    """AGG13-AGG16: groups (flag, features[, weight]) -> a row a feature with means and smd.

    With weights, moments are weighted and variances are the population's.
    """
    long = groups.select(F.col(flag).alias("is_case"), (F.col(weight) if weight else F.lit(1.0)).alias("w"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features))).alias("e")).select("is_case", "w", "e.*").where("x is not null and not isnan(x)")
    if weight:
        means = long.groupBy("feature", "is_case").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
        spread = long.join(means, ["feature", "is_case"]).groupBy("feature", "is_case").agg(F.first("m").alias("m"), (F.sum(F.col("w") * F.pow(F.col("x") - F.col("m"), 2)) / F.sum("w")).alias("v"), F.count("*").alias("n"))
    else:
        spread = long.groupBy("feature", "is_case").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count("*").alias("n"))
    pick = lambda c, case: F.max(F.when(F.col("is_case") == case, F.col(c)))
    wide = spread.groupBy("feature").agg(*(pick(c, case).alias(f"{side}_{c}") for c in ("m", "v", "n") for side, case in (("case", True), ("control", False))))
    value = smd(*(F.col(f"{s}_{c}") for c in ("m", "v", "n") for s in ("case", "control")))
    return wide.select("feature", F.col("case_m").alias("case_mean"), F.col("control_m").alias("control_mean"), value.alias("smd"))


def case_weights(pairs: DataFrame) -> DataFrame:
    """AGG16, DQ6: 1 over the number of the case's pairs; they sum to the number of cases."""
    return pairs.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("case_accession", "case_position")))


def seed_sweep(edges: DataFrame, seeds: list[int], k: int = 5) -> DataFrame:
    """STAT15: greedy pairs under each seed, tagged; all seeds take their rounds together."""
    return _rounds(edges.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))), k)


class SubtypeMismatchError(ValueError):
    """A pair whose two sides differ in a column that they were matched on."""


def pair_subtypes(pairs: DataFrame, cases: DataFrame, controls: DataFrame, column: str = "subtype") -> DataFrame:
    """JN11: pairs with the column of either side."""
    side = lambda rows, s: rows.select(F.col("accession").alias(f"{s}_accession"), F.col("position").alias(f"{s}_position"), F.col(column).alias(f"{column}_{s}"))
    return pairs.join(side(cases, "case"), ["case_accession", "case_position"]).join(side(controls, "control"), ["control_accession", "control_position"])


def checked_subtypes(pairs: DataFrame, cases: DataFrame, controls: DataFrame, column: str = "subtype") -> DataFrame:
    """JN11, DQ9: the same; a pair whose sides differ, or lack the column, is an error."""
    rows = pair_subtypes(pairs, cases, controls, column)
    if not rows.where(~F.coalesce(F.col(f"{column}_case") == F.col(f"{column}_control"), F.lit(False))).isEmpty():
        raise SubtypeMismatchError(f"{column} differs within a pair")
    return rows
