"""The classifier is fitted in blocks: the driver holds the labelled documents' terms once."""

import tracemalloc

import numpy as np

from auditlake.llm import quality


def test_fitting_holds_no_second_copy_of_the_terms():
    rng = np.random.default_rng(4)
    x = (rng.random((quality.SAMPLE, quality.N_TERMS), np.float32) < 0.1).astype(np.float32) * rng.random(quality.N_TERMS, np.float32)
    y = (x[:, 0] > 0).astype(np.float32)
    tracemalloc.start()
    model = quality.Model(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * quality.N_TERMS**2  # the sum of products and what its eigenvectors take, not x over again
    z = ((x - model.mean) * model.scale).astype(np.float32)
    whole = z.T.astype(np.float64) @ z
    spread = lambda axes: np.trace(axes.T @ whole @ axes)
    assert np.isclose(spread(model.axes.astype(np.float64)), np.linalg.eigvalsh(whole)[-quality.RANK :].sum(), rtol=1e-5)
