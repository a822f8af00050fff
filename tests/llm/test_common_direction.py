"""Near pairs right at the threshold, of vectors with a common direction or in one cluster."""

import numpy as np
from test_vectors import links_of, roots

from pathweave.llm import quantisation


def near_threshold(rng, base, dims):
    """Partners at a cosine of 0.90 to 0.92."""
    turn = rng.standard_normal(base.shape)
    turn = quantisation.units(turn - np.einsum("ij,ij->i", turn, base)[:, None] * base)
    c = rng.uniform(0.9005, 0.92, (len(base), 1))
    return c * base + np.sqrt(1 - c * c) * turn


def test_links_at_the_threshold(spark):
    rng, dims = np.random.default_rng(6), 32
    common = quantisation.units(rng.standard_normal((1, dims)))
    towards = lambda n, share: np.sqrt(share) * common + np.sqrt(1 - share) * quantisation.units(rng.standard_normal((n, dims)))
    for base in (quantisation.units(towards(400, 0.8)), quantisation.units(np.concatenate([towards(130, 0.9), rng.standard_normal((270, dims))]))):
        v = np.concatenate([base, near_threshold(rng, base, dims)])
        near = links_of(v)
        rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = {r.id: r for r in quantisation.links(rows).collect()}
        n = np.array([got[i].n_links for i in range(len(v))])
        assert near.sum() >= 800 and n.sum() >= 0.999 * near.sum() and (n <= near.sum(axis=1)).all()
        assert np.mean([got[i].component_id == r for i, r in enumerate(roots(near))]) > 0.99
