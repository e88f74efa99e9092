"""A text may have as many languages as there are."""

import numpy as np

from threadloom.llm import langid


def test_mixtures_of_more_than_three_languages():
    p = np.full((5, langid.BUCKETS), 1e-6, np.float32)
    for k in range(5):
        p[k, k * 100 : k * 100 + 100] = 1
    model = langid.Model(tuple("abcde"), p / p.sum(1, keepdims=True))
    counts = np.zeros((3, langid.BUCKETS), np.float32)
    counts[0, :400], counts[1, :500], counts[2, :100] = 9, 9, 9
    got = model.mixtures(counts)
    assert [(row > 0.005).sum() for row in got] == [4, 5, 1]
    assert np.allclose(got[0, :4], 0.25, atol=0.01) and np.allclose(got[1], 0.2, atol=0.01)


def plain_mixture(p, counts, tolerance):
    """One text by loops: expectation-maximisation over all languages, then over the first 1, 2, ... of them, and BIC."""
    languages, n = range(len(p)), sum(counts)

    def em(pi):
        while True:
            share = [0.0] * len(p)
            for b, c in enumerate(counts):
                if c:
                    total = sum(pi[k] * p[k][b] for k in languages)
                    for k in languages:
                        share[k] += c * pi[k] * p[k][b] / total / n
            moved = max(abs(a - b) for a, b in zip(share, pi, strict=True))
            pi = share
            if moved <= tolerance:
                return pi

    full = em([1 / len(p)] * len(p))
    order = sorted(languages, key=lambda k: -full[k])
    best = None
    for size in range(1, len(p) + 1):
        pi = [max(full[k], 1e-3) if k in order[:size] else 0.0 for k in languages]
        pi = [x / sum(pi) for x in pi]
        pi = em(pi) if size > 1 else pi
        fit = sum(c * np.log(sum(pi[k] * p[k][b] for k in languages)) for b, c in enumerate(counts) if c)
        cost = -2 * langid.EFFECTIVE * fit + (size - 1) * np.log(max(n * langid.EFFECTIVE, 2))
        if best is None or cost < best[0]:
            best = cost, pi
    return best[1]


def test_mixtures_against_a_plain_expectation_maximisation():
    r = np.random.default_rng(7)
    p = r.dirichlet(np.full(60, 0.3), 4)
    p = (p + 1e-4) / (p + 1e-4).sum(1, keepdims=True)
    wide = np.full((4, langid.BUCKETS), 1e-12, np.float32)
    wide[:, :60] = p
    texts = []
    for shares in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.1, 0.2, 0.3, 0.4], [0, 0.9, 0.1, 0], [0.25] * 4):
        for n in (5, 40, 900):
            texts.append(r.multinomial(n, np.array(shares) @ p / (np.array(shares) @ p).sum()))
    counts = np.zeros((len(texts), langid.BUCKETS), np.float32)
    counts[:, :60] = texts
    got = langid.Model(tuple("abcd"), wide).mixtures(counts)
    for row, c in zip(got, texts, strict=True):
        want = plain_mixture(p, c, langid.TOLERANCE)
        assert [x > 0 for x in row] == [x > 0 for x in want]
        assert np.allclose(row, want, atol=0.02)


def test_draws_are_never_empty():
    from threadloom.llm.common import draw_limit

    assert draw_limit(4000, 10**11) > 0 and draw_limit(4000, 10**30) == 1 and draw_limit(4000, 10) == 2**63 - 1 == draw_limit(10, 10)
