"""Model execution per chain, score columns, validation, retention, segment reductions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import exprs as x
from siteloom.functions import vocab as v
from siteloom.operators.adapters import MODELS, WeightedModel
from siteloom.operators.structures import aligned


class SequonScorer(Protocol):
    """UDF1: a model that gives each place of a chain a distribution over the alphabet, in several orders.

    ``probabilities`` must raise for a place that it didn't evaluate; it must never invent a score. A model that
    takes several chains at once has ``probabilities_many`` too, with lists of both arguments.
    """

    def describe(self) -> dict[str, object]: ...

    def decodable(self, sequence: str) -> np.ndarray: ...

    def probabilities(self, sequence: str, places: list[int]) -> np.ndarray: ...


class SequenceDesigner(Protocol):
    """UDF2."""

    def design(self, sequence: str, n_designs: int, temperature: float, seed: int) -> list[str]: ...


class HashModel:
    """Deterministic scorer and designer without weights, for tests and plumbing."""

    def __init__(self, n_orders: int = 8, seed: int = 0):
        self.n_orders, self.seed = n_orders, seed

    def describe(self) -> dict[str, object]:
        return {"model": "hash", "conditioning": "none", "n_orders": self.n_orders, "seed": self.seed}

    def decodable(self, sequence: str) -> np.ndarray:
        return np.array([c != "X" for c in sequence])

    def probabilities(self, sequence: str, places: list[int]) -> np.ndarray:
        if any(not 0 <= p < len(sequence) or sequence[p] == "X" for p in places):
            raise ValueError(f"incomplete_backbone_at_model_index_{places}")
        out = np.empty((self.n_orders, len(places), len(v.ALPHABET)))
        for o in range(self.n_orders):
            for i, p in enumerate(places):
                own = hashlib.sha256(f"{self.seed}-{o}-{p}-{sequence[max(0, p - 3) : p + 4]}".encode()).digest()
                weights = np.frombuffer(own[: len(v.ALPHABET)], np.uint8).astype(float) + 1
                out[o, i] = weights / weights.sum()
        return out

    def design(self, sequence: str, n_designs: int, temperature: float, seed: int) -> list[str]:
        r = np.random.default_rng([seed, int.from_bytes(hashlib.sha256(sequence.encode()).digest()[:8], "big")])
        letters = np.array(list(v.ALPHABET[:20]))
        out = []
        for _ in range(n_designs):
            change = r.random(len(sequence)) < min(1.0, temperature)
            out.append("".join(np.where(change, letters[r.integers(0, 20, len(sequence))], list(sequence))))
        return out


_MODELS: dict[str, Callable[..., object]] = {"hash": HashModel, **{name: partial(WeightedModel, name) for name in MODELS}}


def register(name: str, factory: Callable[..., object]) -> None:
    """UDF3: factories run on the executors, at the first chain of a worker, so models load lazily."""
    _MODELS[name] = factory


def unregister(name: str) -> None:
    _MODELS.pop(name, None)


def available() -> list[str]:
    return sorted(_MODELS)


def load(name: str, **options):
    """UDF3, UDF4: options that are None are left out; an unknown name is an error."""
    if name not in _MODELS:
        raise KeyError(name)
    return _MODELS[name](**{k: o for k, o in options.items() if o is not None})


def packed(lengths: list[int], slots: int = v.DESIGN_SLOTS) -> list[list[int]]:
    """FN33: which of the chains go together: by length, as many as keep within the slots when each takes as many as the longest of them.

    A chain that is longer than the slots goes alone.
    """
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if out and (len(out[-1]) + 1) * lengths[i] <= slots:
            out[-1].append(i)
        else:
            out.append([i])
    return out


CHAIN = ("structure_pdb_id", "structure_chain_id")
#: Chains, and sites of them, that a task scores at a time.
CHAINS, SITES = 200, 2000
SCORED = "n_decoding_orders int, conditional_sequon_score double, conditional_sequon_score_sd double, probs_n array<double>, probs_plus1 array<double>, probs_plus2 array<double>, error string"


def score_chains(manifest: DataFrame, sequences: DataFrame, model: str, slots: int = v.DESIGN_SLOTS, **options) -> DataFrame:
    """UDF1, SNK3, AGG31: manifest rows scored chain by chain; what raised has an error and no score.

    manifest has MODEL_KEY and the three model indices; sequences (structure_pdb_id, structure_chain_id,
    sequence). Order-averaged vectors go out, never whole tensors. The sites of the chains in an Arrow batch go
    to the model in packs of like length within ``slots`` residues, if it takes several; if a pack raises, its
    sites are tried one by one, so that only what is at fault fails.
    """
    factory = _MODELS[model] if model in _MODELS else load(model)
    chosen = {k: o for k, o in options.items() if o is not None}
    index = ["n_model_index", "plus1_model_index", "plus2_model_index"]
    site = ["accession", "position"]
    names = [*site, *CHAIN, *(c.split()[0] for c in SCORED.split(", "))]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3, pa.string()]
    at = v.ALPHABET.index

    def odds(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def checked(p: np.ndarray) -> list:
        if (np.abs(p.sum(axis=2) - 1) > 1e-3).any() or p.min() < 0 or p.max() > 1 + 1e-3:
            raise ValueError("not_a_distribution")
        each = (odds(p[:, 0, at("N")]) + odds(p[:, 2, at("S")] + p[:, 2, at("T")])) / 2
        return [len(p), each.mean(), each.std(ddof=1) if len(each) > 1 else 0.0, *(m.tolist() for m in p.mean(axis=0)), None]

    def one(own, sequence: str | None, places: list) -> list:
        try:
            if sequence is None:
                raise ValueError("chain_not_found")
            return checked(own.probabilities(sequence, [int(i) for i in places]))
        except Exception as e:  # a failure is a row of its own
            return [*[None] * 6, f"{type(e).__name__}: {str(e)[:120]}"]

    def several(own, asked: list[tuple[str | None, list]]) -> list[list]:
        found = [None] * len(asked)
        if hasattr(own, "probabilities_many"):
            whole = [i for i, (sequence, places) in enumerate(asked) if sequence is not None and None not in places]
            for pack in packed([len(asked[i][0]) for i in whole], slots):
                mine = [whole[k] for k in pack]
                try:
                    for i, p in zip(mine, own.probabilities_many([asked[i][0] for i in mine], [[int(k) for k in asked[i][1]] for i in mine]), strict=True):
                        found[i] = checked(p)
                except Exception:  # whose fault it is shows below
                    for i in mine:
                        found[i] = None
        return [f if f is not None else one(own, *a) for f, a in zip(found, asked)]

    def run(batches):
        own = factory(**chosen)
        # a chain may have hundreds of sites, and a scored site is some thousand bytes: few are held at a time
        for part in (b.slice(i, CHAINS) for b in batches for i in range(0, b.num_rows, CHAINS)):
            rows = [((s["accession"], s["position"], r["structure_pdb_id"], r["structure_chain_id"]), (r["sequence"], [s[c] for c in index])) for r in part.to_pylist() for s in r["sites"]]
            for some in (rows[i : i + SITES] for i in range(0, len(rows), SITES)):
                made = [[*base, *got] for (base, _), got in zip(some, several(own, [asked for _, asked in some]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    # a chain's sequence goes out once, with all its places
    rows = manifest.groupBy(*CHAIN).agg(F.collect_list(F.struct(*site, *index)).alias("sites")).join(sequences.select(*CHAIN, "sequence"), list(CHAIN), "left")
    out = rows.mapInArrow(run, "accession string, position int, structure_pdb_id string, structure_chain_id string, " + SCORED)
    described = factory(**chosen).describe()  # UDF8
    n, plus2 = F.col("probs_n"), F.col("probs_plus2")
    p_n, p_s, p_t = x.letter(n, "N"), x.letter(plus2, "S"), x.letter(plus2, "T")
    return out.withColumns({"p_asn_at_n": p_n, "p_ser_at_plus2": p_s, "p_thr_at_plus2": p_t, "p_ser_or_thr_at_plus2": p_s + p_t, "p_pro_at_plus1": x.letter(F.col("probs_plus1"), "P"), "logit_p_asn": x.logit(p_n), "logit_p_ser_or_thr": x.logit(p_s + p_t), **{k: F.lit(o) for k, o in described.items()}})


def index_maps(native: DataFrame, model: DataFrame) -> DataFrame:
    """JN23: for chains as the manifest reads them (.., sequence) and as a model does (.., model_sequence, finite), the map from places of one to places of the other.

    Equal sequences map place by place; others are aligned, and only these leave the JVM.
    """
    both = native.select(*CHAIN, "sequence").join(model.select(*CHAIN, "model_sequence", "finite"), list(CHAIN))
    places = F.when(F.length("sequence") > 0, F.sequence(F.lit(0), F.length("sequence") - 1)).otherwise(F.array().cast("array<int>"))
    equal = both.where("sequence = model_sequence").withColumn("to_model", F.map_from_arrays(places, places))
    pairs = F.map_entries(aligned("sequence", "model_sequence")["pairs"])
    other = both.where("sequence <> model_sequence").withColumn("to_model", F.map_from_entries(F.transform(pairs, lambda e: F.struct((e["key"] - 1).alias("key"), (e["value"] - 1).alias("value")))))
    return equal.unionByName(other).drop("sequence")


def guarded_indices(manifest: DataFrame, maps: DataFrame) -> DataFrame:
    """FN38: manifest rows with the model's own places, or the reason why there are none.

    manifest has the three model indices and the triplet; maps comes from index_maps(). A place must have a
    counterpart with a finite backbone, and the three must spell the recorded triplet: a shifted index would
    score the wrong residue and still look plausible.
    """
    rows = manifest.join(maps, list(CHAIN), "left")
    asked = F.array("n_model_index", "plus1_model_index", "plus2_model_index")
    rows = rows.withColumn("places", F.transform(asked, lambda i: F.try_element_at("to_model", i.cast("int"))))
    lost = F.filter(asked, lambda i: F.try_element_at("to_model", i.cast("int")).isNull())
    broken = F.filter("places", lambda i: ~F.coalesce(F.get("finite", i), F.lit(False)))
    seen = F.array_join(F.transform("places", lambda i: F.substring("model_sequence", i + 1, F.lit(1))), "")
    listed = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    reason = (
        F.when(F.col("to_model").isNull(), "ChainUnreadableError: chain_not_found")
        .when(F.size(lost) > 0, F.concat(F.lit("IncompleteBackboneError: no counterpart of "), listed(lost)))
        .when(F.size(broken) > 0, F.concat(F.lit("IncompleteBackboneError: incomplete at "), listed(broken)))
        .when(seen != F.col("triplet"), F.concat(F.lit("SequonMismatchError: "), seen, F.lit(" for "), F.col("triplet")))
    )
    rows = rows.withColumn("error", reason)
    return rows.select(*manifest.columns, F.when(F.col("error").isNull(), F.col("places")).alias("places"), "error")


def failures(scored: DataFrame) -> DataFrame:
    """SNK3: the rows that raised, and why."""
    return scored.where("error is not null").select("accession", "position", "structure_pdb_id", "structure_chain_id", F.col("error").alias("reason"))


def design_chains(manifest: DataFrame, sequences: DataFrame, model: str, n_designs: int = 32, temperature: float = 0.1, seed: int = 0, first: int = 8, **options) -> DataFrame:
    """UDF2, AGG26: retention of each motif over a chain's designs, of all and of the first few."""
    factory = _MODELS[model]
    chain = ["structure_pdb_id", "structure_chain_id"]

    def run(batches):
        own = factory(**options)
        for pdf in batches:
            pdf["designs"] = [own.design(s, n_designs, temperature, seed) for s in pdf["sequence"]]
            yield pdf[[*chain, "designs"]]

    designs = sequences.where("sequence is not null").select(*chain, "sequence").mapInPandas(run, "structure_pdb_id string, structure_chain_id string, designs array<string>")
    rows = manifest.join(designs, chain)
    places = [F.col(f"{c}_model_index") for c in ("n", "plus1", "plus2")]
    return rows.select("accession", "position", *chain, x.retention(F.col("designs"), *places).alias("std"), x.retention(F.slice("designs", 1, first), *places).alias("pre"))


def scoreability(manifest: DataFrame, masks: DataFrame) -> DataFrame:
    """FN29: manifest with masks (chain, mask) -> scoreable and why not."""
    places = F.array("n_model_index", "plus1_model_index", "plus2_model_index")
    rows = manifest.join(masks, ["structure_pdb_id", "structure_chain_id"], "left").withColumn("scoreable", F.coalesce(x.scoreable(F.col("mask"), places), F.lit(False)))
    bad = F.filter(places, lambda i: ~F.coalesce((i >= 0) & F.get(F.col("mask"), i), F.lit(False)))
    reason = F.when(~F.col("scoreable"), F.concat(F.lit("incomplete_backbone_at_model_index_["), F.array_join(bad.cast("array<string>"), ", "), F.lit("]"))).otherwise("")
    return rows.select("accession", "position", "structure_pdb_id", "structure_chain_id", "scoreable", reason.alias("reason"))


def order_scores(tensors: DataFrame, orders: int) -> DataFrame:
    """FN39, AGG31: rows (key, order, at_n, at_plus2) scored over the first few orders only."""
    each = tensors.where(F.col("order") < orders).withColumn("s", x.sequon_score(F.col("at_n"), F.col("at_plus2")))
    return each.groupBy("key").agg(F.avg("s").alias("score"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("score_sd"), F.count("*").alias("n_orders"))


def segment_reduce(rows: DataFrame, size: int | None = None, index: str = "index", value: str = "src") -> DataFrame:
    """UDF9: sum, mean, min, max and product by index, one row for each index from 0; empty ones are zero, product one."""
    out = rows.groupBy(index).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.product(F.col(value).cast("double")).alias("mul"))
    if size is None:
        top = rows.agg(F.max(index)).first()[0]
        size = 0 if top is None else top + 1
    every = rows.sparkSession.range(size).withColumnRenamed("id", index)
    return every.join(out, index, "left").na.fill(0, ["sum", "mean", "min", "max"]).na.fill(1.0, ["mul"])
