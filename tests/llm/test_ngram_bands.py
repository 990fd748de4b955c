"""The pigeonhole scheme finds every similar pair, whatever the list of frequent elements."""

import random
from fractions import Fraction

import numpy as np
import pytest

from tideloom.llm.ngram_join import Bands
from tideloom.llm.wordhash import mix


@pytest.mark.parametrize("threshold", ["0.5", "0.8", "0.9"])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.9])
def test_similar_sets_share_a_signature(threshold, share):
    rng = random.Random(7)
    t = Fraction(threshold)
    universe = mix(np.arange(1, 4000, dtype=np.uint64))
    frequent = np.sort(universe[: int(share * 400)])
    bands = Bands(threshold, frequent)
    checked = 0
    for _ in range(600):
        size = rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200, 350])
        a = set(rng.sample(range(400 if rng.random() < 0.7 else 3999), size))
        b = set(a)
        for _ in range(rng.randint(0, max(1, int(size * float(1 - t))))):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(3999))
        if not len(a & b) >= t * len(a | b):
            continue
        x, y = (np.sort(universe[sorted(z)]) for z in (a, b))
        checked += 1
        assert set(bands.signatures(x).tolist()) & set(bands.signatures(y).tolist()), (len(a), len(b), len(a & b))
    assert checked > 200
