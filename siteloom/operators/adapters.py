"""Models with weights: how a chain is prepared, masked, decoded in orders and checked, whatever network answers.

The networks themselves need packages and weights that executors must have; a backend is loaded at the first
chain of a worker, and its absence is an error that says what is missing.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

import numpy as np

from siteloom.functions import vocab as v


class ModelUnavailableError(RuntimeError):
    """The package or the weights of a model aren't installed here."""


class IncompleteBackboneError(ValueError):
    """A place that the model can't evaluate."""


class SequonMismatchError(ValueError):
    """The model reads other residues than the manifest records."""


class Backend(Protocol):
    """One pass of a network over a chain.

    ``letters`` names its columns. ``predict`` gives a row a place, each a distribution, as the network
    sees the chain with the places in ``hidden`` out of its sight. ``usable`` needs no pass. A backend that can
    take several chains in a pass may have ``predict_many``, with a list of predict's arguments.
    """

    letters: str

    def usable(self, sequence: str) -> np.ndarray: ...

    def predict(self, sequence: str, places: list[int], hidden: list[int], order: int) -> np.ndarray: ...

    def sample(self, sequence: str, n: int, temperature: float, seed: int) -> list[str]: ...


# Of each model its package, checkpoint, decoding orders, and conditioning by mask mode.
MODELS = {
    "proteinmpnn": {"package": "protein_mpnn_utils", "checkpoint": "v_48_020", "orders": 8, "masks": {"single": "conditional", "joint": "conditional_sequon_masked"}, "designs": True},
    "esm_if": {"package": "esm.inverse_folding", "checkpoint": "esm_if1_gvp4_t16_142M_UR50", "orders": 1, "masks": {"single": "autoregressive_native_prefix"}, "designs": True},
    "esmc": {"package": "esm.models.esmc", "checkpoint": "esmc_300m", "orders": 1, "masks": {"single": "masked_single", "joint": "masked_joint"}, "designs": False},
}
#: backends by model name: a callable that loads one
_BACKENDS: dict[str, Callable[..., Backend]] = {}


def register_backend(model: str, load: Callable[..., Backend]) -> None:
    """Says how a model's network is loaded on an executor."""
    _BACKENDS[model] = load


class EchoNetwork:
    """A backend without weights, for tests and plumbing: nine tenths for the residue that it sees, nothing known where others are hidden."""

    letters = v.ALPHABET

    def __init__(self, **_):
        pass

    def usable(self, sequence: str) -> np.ndarray:
        return np.array([c != "X" for c in sequence])

    def predict(self, sequence: str, places: list[int], hidden: list[int], order: int) -> np.ndarray:
        n = len(self.letters)
        out = np.full((len(places), n), 1 / n if hidden else 0.1 / (n - 1))
        if not hidden:
            out[np.arange(len(places)), [self.letters.index(sequence[p]) for p in places]] = 0.9
        return out

    def sample(self, sequence: str, n: int, temperature: float, seed: int) -> list[str]:
        return [sequence] * n


class StepNetwork(EchoNetwork):
    """A backend without weights whose answer depends on the place, the order, how much is hidden, and the next residue if it is seen."""

    letters = v.ALPHABET[::-1]

    def predict(self, sequence: str, places: list[int], hidden: list[int], order: int) -> np.ndarray:
        at = np.array([v.ALPHABET.index(c) for c in self.letters])
        seen = np.array([v.ALPHABET.index(sequence[p + 1]) if p + 1 < len(sequence) and p + 1 not in hidden else len(at) for p in places])
        weights = 1.0 + (7 * at + 3 * np.array(places)[:, None] + 5 * order + 11 * len(hidden) + 17 * seen[:, None]) % 13
        return weights / weights.sum(axis=1, keepdims=True)


class WeightedModel:
    """UDF5-UDF7: scorer, and designer where the model can write, around a backend.

    Options that the model doesn't know are refused, not ignored. ``mask_mode`` single shows the network the
    other residues of the motif, joint hides all three while any is asked about.
    """

    def __init__(self, name: str, checkpoint: str | None = None, n_orders: int | None = None, mask_mode: str = "single", seed: int = 0, max_batch: int | None = None, device: str = "auto"):
        known = MODELS[name]
        if mask_mode not in known["masks"]:
            raise ValueError(f"{name} has no mask mode {mask_mode}")
        if n_orders not in (None, known["orders"]) and known["orders"] == 1:
            raise ValueError(f"{name} decodes in one order")
        if max_batch is not None and not known["designs"]:
            raise ValueError(f"{name} writes no sequences")
        self.name, self.mask_mode, self.seed, self.max_batch, self.device = name, mask_mode, seed, max_batch, device
        self.checkpoint, self.n_orders = checkpoint or known["checkpoint"], n_orders or known["orders"]
        self._backend: Backend | None = None

    @property
    def backend(self) -> Backend:
        if self._backend is None:
            if self.name not in _BACKENDS:
                package = MODELS[self.name]["package"]
                try:
                    importlib.import_module(package)
                except ImportError as e:
                    raise ModelUnavailableError(f"{self.name} needs the package {package}, which isn't installed") from e
                raise ModelUnavailableError(f"no backend is registered for {self.name}")
            self._backend = _BACKENDS[self.name](checkpoint=self.checkpoint, device=resolved_device(self.device))
        return self._backend

    def describe(self) -> dict[str, object]:
        """UDF8."""
        return {"model": self.checkpoint, "conditioning": MODELS[self.name]["masks"][self.mask_mode], "n_orders": self.n_orders, "seed": self.seed}

    def decodable(self, sequence: str) -> np.ndarray:
        return np.asarray(self.backend.usable(sequence), bool)

    def probabilities(self, sequence: str, places: list[int]) -> np.ndarray:
        """(orders, places, alphabet); a place that the backend can't evaluate raises before any pass."""
        return self.probabilities_many([sequence], [places])[0]

    def probabilities_many(self, sequences: list[str], places: list[list[int]]) -> list[np.ndarray]:
        """probabilities() of several chains; each pass of the network takes all of them once."""
        for sequence, asked in zip(sequences, places):
            usable = self.decodable(sequence)
            bad = [p for p in asked if not 0 <= p < len(usable) or not usable[p]]
            if bad:
                raise IncompleteBackboneError(f"incomplete_backbone_at_model_index_{bad}")
        together = getattr(self.backend, "predict_many", lambda asks: [self.backend.predict(*ask) for ask in asks])
        letters = [self.backend.letters.index(c) for c in v.ALPHABET if c in self.backend.letters]
        columns = [i for i, c in enumerate(v.ALPHABET) if c in self.backend.letters]
        out = [np.zeros((self.n_orders, len(asked), len(v.ALPHABET))) for asked in places]
        for order in range(self.n_orders):
            if self.mask_mode == "single":
                rows = together([(s, asked, [], self.seed + order) for s, asked in zip(sequences, places)])
            else:
                parts: list[list] = [[] for _ in places]
                for k in range(max(map(len, places), default=0)):
                    some = [i for i, asked in enumerate(places) if k < len(asked)]
                    for i, row in zip(some, together([(sequences[i], [places[i][k]], [q for q in places[i] if q != places[i][k]], self.seed + order) for i in some])):
                        parts[i].append(row)
                rows = [np.concatenate(p) for p in parts]
            for own, row in zip(out, rows):
                own[order][:, columns] = np.asarray(row)[:, letters]
        return out

    def design(self, sequence: str, n_designs: int, temperature: float, seed: int) -> list[str]:
        """Whole sequences with nothing held fixed, FN33 of them at a time."""
        if not MODELS[self.name]["designs"]:
            raise ModelUnavailableError(f"{self.name} writes no sequences")
        size = max(1, min(n_designs, self.max_batch or v.DESIGN_SLOTS // max(1, len(sequence))))
        out: list[str] = []
        while len(out) < n_designs:
            out += self.backend.sample(sequence, min(size, n_designs - len(out)), temperature, seed + len(out))
        return out


def resolved_device(asked: str | None) -> str:
    """UDF10: the device asked for if it is there, else the processor; a slow run is better than none."""
    try:
        torch = importlib.import_module("torch")
    except ImportError:
        return "cpu"
    if asked in (None, "auto"):
        return "cuda" if torch.cuda.is_available() else "cpu"
    there = {"cuda": torch.cuda.is_available, "mps": lambda: torch.backends.mps.is_available()}.get(asked.split(":")[0], lambda: True)
    return asked if there() else "cpu"


def located(marker: str, folders: list[str], variable: str) -> Path:
    """UDF10: the first folder that holds the marker file, the one that the variable names before all others."""
    named = os.environ.get(variable)
    tried = [Path(f).expanduser() for f in ([named] if named else []) + folders]
    for folder in tried:
        if (folder / marker).is_file():
            return folder
    raise ModelUnavailableError(f"{marker} is in none of {', '.join(map(str, tried))}; set {variable}")
