"""The fit makes the same number of passes at every size."""

import numpy as np
import pytest

from quillgraph.llm import toxicity


class Counted:
    def __init__(self, seed):
        self.rng, self.passes = np.random.Generator(np.random.PCG64(seed)), 0

    def permutation(self, n):
        self.passes += 1
        return self.rng.permutation(n)


@pytest.mark.parametrize("n", [100, 10000, 20000])
def test_passes(monkeypatch, n):
    made = []
    monkeypatch.setattr(toxicity.np.random, "default_rng", lambda seed: made.append(Counted(seed)) or made[-1])
    toxicity.fit_rows([np.array([i % 2, 2 + i % 5]) for i in range(n)], np.arange(n) % 2, least=1)
    assert made[0].passes == toxicity.PASSES
