"""Exact quantiles of any number of classes by distributed selection: no buffer grows with a class.

A class of LEFT values or fewer is ranked as it is. In a larger one every wanted rank is bracketed: a sketch
of bounded size over the values still open gives cuts, two of which enclose the rank up to the sketch's error;
exact counts below, at and between the two then decide, so an error costs a round and never a result. Each
round leaves a few in GRID of the values open, ties of a cut are settled by their count alone, and all
classes and ranks go together. Only counts and sketches are shuffled until LEFT values are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.exprs import no_nan
from siteloom.operators.graph import cut

#: Values of a class, or of a bracket, that are ranked in one task; cuts of a sketch.
LEFT, GRID = 100_000, 256


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by])


def _inside(x: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Each value with the brackets of its class that it lies strictly between; x has the classes as by, brackets as of_<by>.

    Brackets are a few for each class of more than LEFT values: they go to the values, whatever Spark's estimates say.
    """
    own = brackets.withColumnsRenamed({c: f"of_{c}" for c in by})
    met = x.join(F.broadcast(own), reduce(lambda a, b: a & b, [x[c].eqNullSafe(own[f"of_{c}"]) for c in by])).drop(*(f"of_{c}" for c in by))
    return met.where((F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi"))))


def _ranked(x: DataFrame, by: list[str]) -> DataFrame:
    """Places from 0 within classes of LEFT values at most."""
    own = Window.partitionBy(*by)
    return x.withColumns({"place": F.row_number().over(own.orderBy("x")).cast("long") - 1, "n": F.count("*").over(own)})


def _select(x: DataFrame, large: DataFrame, by: list[str], probabilities: list[float]) -> list[DataFrame]:
    """Tables (by, n, place, x) of the wanted places of large classes."""
    ends = [f((F.col("n") - 1) * F.lit(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)]
    nothing = F.lit(None).cast("double")
    state = large.select(*by, "n", F.explode(F.array_distinct(F.array(*ends))).alias("place")).withColumns({"lo": nothing, "hi": nothing, "below": F.lit(0).cast("long")})
    found, key, first = [], [*by, "place"], True
    while True:
        state = cut(state)
        if not first and state.isEmpty():
            return found
        first = False
        sketch = _inside(x, state, by).groupBy(*key).agg(F.count("*").alias("m"), F.percentile_approx("x", [i / GRID for i in range(GRID + 1)], 20 * GRID).alias("grid"))
        open_ = cut(state.withColumnsRenamed({c: f"s_{c}" for c in key}).join(sketch, reduce(lambda a, b: a & b, [F.col(f"s_{c}").eqNullSafe(F.col(c)) for c in key])).drop(*(f"s_{c}" for c in key)))
        few = open_.where(F.col("m") <= LEFT).drop("grid", "m")
        places = _inside(x, few, by).withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("x")) - 1 + F.col("below"))
        found.append(cut(places.where("at = place").select(*by, "n", "place", "x")))
        at = F.floor((F.col("place") - F.col("below")) / F.col("m") * GRID).cast("int")
        tried = open_.where(F.col("m") > LEFT).withColumns({"a": F.get("grid", F.greatest(at - 1, F.lit(0))), "b": F.get("grid", F.least(at + 2, F.lit(GRID)))}).drop("grid", "m")
        v, a, b = F.col("x"), F.col("a"), F.col("b")
        counts = _inside(x, tried, by).groupBy(*key, "n", "lo", "hi", "below", "a", "b").agg(F.count_if(v < a).alias("under"), F.count_if(v == a).alias("at_a"), F.count_if((v > a) & (v < b)).alias("within"), F.count_if((v == b) & (b > a)).alias("at_b"))
        rank, upto_a = F.col("place") - F.col("below"), F.col("under") + F.col("at_a")
        upto_b = upto_a + F.col("within") + F.col("at_b")
        counts = cut(counts.withColumn("where", F.when(rank < F.col("under"), 0).when(rank < upto_a, 1).when(rank < upto_a + F.col("within"), 2).when(rank < upto_b, 3).otherwise(4)))
        found.append(counts.where(F.col("where").isin(1, 3)).select(*by, "n", "place", F.when(F.col("where") == 1, a).otherwise(b).alias("x")))
        side = F.col("where")
        state = counts.where(side.isin(0, 2, 4)).select(*key, "n", F.when(side == 0, F.col("lo")).when(side == 2, a).otherwise(b).alias("lo"), F.when(side == 0, a).when(side == 2, b).otherwise(F.col("hi")).alias("hi"), (F.col("below") + F.when(side == 0, 0).when(side == 2, upto_a).otherwise(upto_b)).alias("below"))


def quantiles(rows: DataFrame, value: str | Column, probabilities: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """A row a class (columns ``by``, null is a class) with its exact quantiles, interpolated linearly, under the names given.

    Null and NaN values don't count; a class without others is left out. Without ``by`` there is one row, of nulls if nothing counts.
    """
    names = list(by) or ["all_at"]
    x = rows.select(*(by or [F.lit(0).alias("all_at")]), no_nan((F.col(value) if isinstance(value, str) else value).cast("double")).alias("x")).where("x is not null")
    counts = cut(x.groupBy(*names).agg(F.count("*").alias("n")))
    large = counts.where(F.col("n") > LEFT)
    if large.isEmpty():
        picks = _ranked(x, names).select(*names, "n", "place", "x")
    else:
        small = counts.where(F.col("n") <= LEFT)
        picks = _ranked(x.join(small.select(*names), _same(x, small, names), "left_semi"), names).select(*names, "n", "place", "x")
        picks = reduce(DataFrame.unionByName, _select(x, large, names, list(probabilities.values())), picks)

    def at(p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(p)
        low, high = (F.max(F.when(F.col("place") == f(place), F.col("x"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(place - F.floor(place))

    out = [at(p).alias(name) for name, p in probabilities.items()]
    return picks.groupBy(*by).agg(*out) if by else picks.agg(*out)
