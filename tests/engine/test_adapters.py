import numpy as np
import pytest

from siteloom.functions import vocab as v
from siteloom.operators import adapters as ad


class Recorder(ad.EchoNetwork):
    letters = v.ALPHABET[::-1]  # another order of columns

    def __init__(self, checkpoint, device):
        self.asked, self.device = [], device

    def predict(self, sequence, places, hidden, order):
        self.asked.append((tuple(places), tuple(hidden), order))
        return super().predict(sequence, places, hidden, order)


@pytest.fixture
def recorder(monkeypatch):
    monkeypatch.setitem(ad._BACKENDS, "proteinmpnn", Recorder)
    monkeypatch.setitem(ad._BACKENDS, "esmc", Recorder)


def test_masks_and_orders(recorder):
    single = ad.WeightedModel("proteinmpnn", n_orders=2, seed=5)
    p = single.probabilities("ANGTX", [1, 2, 3])
    assert p.shape == (2, 3, 21) and np.allclose(p.sum(axis=2), 1) and np.isclose(p[0, 0, v.ALPHABET.index("N")], 0.9)
    assert single.backend.asked == [((1, 2, 3), (), 5), ((1, 2, 3), (), 6)]
    joint = ad.WeightedModel("proteinmpnn", n_orders=1, mask_mode="joint")
    joint.probabilities("ANGTX", [1, 2, 3])
    assert [(a, h) for a, h, _ in joint.backend.asked] == [((1,), (2, 3)), ((2,), (1, 3)), ((3,), (1, 2))]
    for places in ([2, 3, 4], [3, 4, 5], [-1, 0, 1]):
        with pytest.raises(ad.IncompleteBackboneError):
            single.probabilities("ANGTX", places)
    assert joint.describe() == {"model": "v_48_020", "conditioning": "conditional_sequon_masked", "n_orders": 1, "seed": 0}


def test_designs_and_options(recorder):
    assert ad.WeightedModel("proteinmpnn", max_batch=3).design("ANGT", 8, 0.1, 0) == ["ANGT"] * 8
    for bad in ({"mask_mode": "odd"}, {"max_batch": 2}, {"n_orders": 4}):
        with pytest.raises(ValueError):
            ad.WeightedModel("esmc", **bad)
    with pytest.raises(ad.ModelUnavailableError):
        ad.WeightedModel("esmc").design("ANGT", 1, 0.1, 0)


def test_absent_models_say_so(tmp_path, monkeypatch):
    with pytest.raises(ad.ModelUnavailableError, match="esm.inverse_folding"):
        ad.WeightedModel("esm_if").decodable("ANGT")
    with pytest.raises(ad.ModelUnavailableError, match="WEIGHTS_AT"):
        ad.located("model.pt", [str(tmp_path)], "WEIGHTS_AT")
    (tmp_path / "model.pt").touch()
    monkeypatch.setenv("WEIGHTS_AT", str(tmp_path))
    assert ad.located("model.pt", ["/nowhere"], "WEIGHTS_AT") == tmp_path and ad.resolved_device("cpu") == "cpu"
