"""That operators get their results by their own method: the network's convolution, and peeled sketches."""

import random

import numpy as np
from pyspark.sql import functions as F

from groundloom.llm import fingerprints, language_id
from groundloom.llm.language_id import FILTERS, WIDTHS, WINDOW, Network


def plain_probabilities(net, row):
    """One window through every filter at every place, one number at a time."""
    active = []
    for f in range(FILTERS * len(WIDTHS)):
        width = WIDTHS[f // FILTERS]
        sums = [sum(float(net.taps[k, row[at + k], f]) for k in range(width)) for at in range(WINDOW)]
        active.append(max(0.0, max(sums) + float(net.shift[f])))
    z = [sum(a * float(net.out[f, c]) for f, a in enumerate(active)) + float(net.bias[c]) for c in range(len(net.languages))]
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


def test_batched_convolution_is_the_plain_one():
    rng = np.random.default_rng(1)
    net = Network.new(["a", "b", "c"], rng)
    net.shift[:] = rng.normal(0, 0.1, len(net.shift))
    net.bias[:] = rng.normal(0, 1, 3)
    texts = ["Dies ist ein Satz. " * 20, "kurz", "日本語のテキスト " * 9]
    x = np.concatenate([language_id.windows(t)[0] for t in texts])
    found = net.probabilities(x)
    for row, p in zip(x, found, strict=True):
        assert np.allclose(plain_probabilities(net, row), p, atol=1e-5)


def test_sketches_are_peeled_and_not_compared_digest_by_digest(spark):
    """Differences of up to 12 digests are read off the fingerprints, larger ones off the larger sketch; counts are those of the sets."""
    rng = random.Random(2)
    draw = lambda n: [rng.getrandbits(63) for _ in range(n)]
    rows, want = [], {}
    for d in range(300):
        shared, few, many = draw(rng.randint(0, 60)), rng.randint(0, 12), rng.randint(60, 200)
        own = shared + draw(few // 2)
        rows.append((d, d, own, shared + draw(few - few // 2), shared[: len(shared) // 2] + draw(many)))
        want[d] = [len(set(own) ^ set(other)) for other in rows[-1][3:]]
    items = fingerprints._items(spark.createDataFrame(rows, "d bigint, h bigint, own array<bigint>, edited array<bigint>, next array<bigint>"))
    both = F.array(F.lit(1), F.lit(2))
    levels = [{r.d: r for r in fingerprints._counts(items, both, level).collect()} for level in (0, 1)]
    peeled = [0, 0, 0]
    for d, (near, far) in want.items():
        first, again = (x.get(d) for x in levels)
        for found, exact in ((first and first.d10, near), (again and again.d11, near), (again and again.d21, far), (first and first.d20, far)):
            assert (found or 0) in (exact, -1)  # a sketch that was peeled is right
        peeled[0] += (first.d10 if first and first.d10 is not None else 0) == near
        peeled[1] += again.d21 == far
        peeled[2] += first.d20 == far
    assert peeled[0] >= 0.97 * 300 and peeled[1] >= 0.98 * 300 and peeled[2] == 0
