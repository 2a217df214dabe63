"""The detectors against plain versions written sample by sample, and drawn intervals against exact ones."""

import itertools
import math

import numpy as np
import pytest

from verdikt.operators import signals as G
from verdikt.operators import stats as S


def plain_peaks(x):
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def plain_prominence(x, p):
    left = right = x[p]
    i = p
    while i >= 0 and x[i] <= x[p]:
        left = min(left, x[i])
        i -= 1
    j = p
    while j < len(x) and x[j] <= x[p]:
        right = min(right, x[j])
        j += 1
    return x[p] - max(left, right)


def plain_spaced(x, peaks, distance):
    left, out = sorted(peaks, key=lambda p: (x[p], p)), []
    while left:
        p = left.pop()
        out.append(p)
        left = [q for q in left if abs(q - p) >= distance]
    return sorted(out)


def plain_transients(x, rate):
    e = [abs(x[i] ** 2 - x[i - 1] * x[i + 1]) for i in range(1, len(x) - 1)]
    usual = float(np.median(e))
    scale = float(np.median([abs(v - usual) for v in e])) / 0.6745
    width = min(int(0.1 * rate) | 1, len(e) if len(e) % 2 else len(e) - 1)
    half = width // 2
    bar = []
    for i in range(len(e)):
        near = sorted(e[k] if 0 <= k < len(e) else 0.0 for k in range(i - half, i + half + 1))
        bar.append(max(12 * near[half], 12 * usual, usual + 15 * scale, 0.02 * max(e)))
    out = []
    for p in plain_spaced(e, [p for p in plain_peaks(e) if e[p] >= bar[p]], max(1, int(0.01 * rate))):
        height = plain_prominence(e, p)
        level = e[p] - height / 2
        a = p
        while a > 0 and e[a] > level:
            a -= 1
        b = p
        while b < len(e) - 1 and e[b] > level:
            b += 1
        a = a + (level - e[a]) / (e[a + 1] - e[a]) if e[a] < level else a
        b = b - (level - e[b]) / (e[b - 1] - e[b]) if e[b] < level else b
        if e[p] > 0 and height >= 0.5 * e[p] and (b - a) / rate <= 0.02:
            out.append(((p + 1) / rate, (b - a) / rate))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_peaks_as_sample_by_sample(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, 200).astype(float) if seed % 2 else rng.standard_normal(200)
    peaks = G.local_peaks(x)
    assert peaks.tolist() == plain_peaks(x)
    assert [G.prominence(x, int(p)) for p in peaks] == pytest.approx([plain_prominence(x, int(p)) for p in peaks])
    if seed % 2 == 0:  # no equal heights
        assert sorted(G.spaced(x, peaks, 7).tolist()) == plain_spaced(x, peaks.tolist(), 7)


@pytest.mark.parametrize("seed,rate", [(1, 1000), (2, 2000), (3, 4000)])
def test_transients_as_sample_by_sample(seed, rate):
    rng = np.random.default_rng(seed)
    x = 0.05 * rng.standard_normal(rate)
    for at in rng.integers(50, rate - 50, 6):
        x[at : at + 8] += rng.uniform(0.5, 2) * np.hanning(8) * np.cos(np.arange(8) * 2)
    want = plain_transients(x.tolist(), rate)
    assert np.allclose(G.transients(x, rate), want) and len(want) >= 3


def test_tonal_frames_as_bin_by_bin():
    rate = 2000
    t = np.arange(rate) / rate
    x = np.where((t > 0.3) & (t < 0.7), np.sin(2 * np.pi * 440 * t), 0.0) + 1e-3 * np.random.default_rng(1).standard_normal(rate)
    size, hop = int(0.064 * rate), (int(0.064 * rate) + 1) // 2
    padded = np.concatenate([np.zeros(size // 2), x, np.zeros(2 * size)])
    frames = []
    for k in range(1 + -(-(len(x) + 2 * (size // 2) - size) // hop)):
        part = padded[k * hop : k * hop + size] * [math.sin(math.pi * i / size) ** 2 for i in range(size)]
        frames.append([abs((part * np.exp(-2j * math.pi * b * np.arange(size) / size)).sum()) * 2 / size for b in range(size // 2 + 1)])
    loudest = max(map(sum, frames))
    want = []
    for k, f in enumerate(frames):
        band = [v if 100 <= b * rate / size <= 1000 else 0.0 for b, v in enumerate(f)]
        flat = math.exp(sum(math.log(v + 1e-12) for v in f) / len(f)) / (sum(f) / len(f) + 1e-12)
        if sum(f) >= 0.1 * loudest and flat < 0.3 and max(band) > 0:
            high = [p for p in plain_peaks(band) if band[p] >= 0.25 * max(band) and plain_prominence(band, p) >= 0.25 * max(band)]
            want.append((k, k * hop / rate, [p * rate / size for p in high or [band.index(max(band))]]))
    got = G.tonal_frames(x, rate)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(np.allclose(g[2], w[2]) for g, w in zip(got, want, strict=True)) and len(got) > 5


def quantile(n, p, share):
    """The exact quantile of a binomial."""
    mass = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    return int(np.searchsorted(mass, share))


@pytest.mark.parametrize("n,right", [(20, 3), (168, 60), (400, 399), (50, 0), (50, 50)])
def test_drawn_interval_is_near_the_exact_one(n, right):
    low, high = S.bootstrap_interval(right, n, ("x", n, right))
    near = 1 if n < 100 else 2  # hits
    assert abs(low * n / 100 - quantile(n, right / n, 0.025)) <= near and abs(high * n / 100 - quantile(n, right / n, 0.975)) <= near


def test_drawn_swaps_are_near_all_swaps():
    for won, lost, n in (([3, 2], [1, 0], [6, 5]), ([4, 1, 2], [0, 1, 0], [5, 5, 5]), ([1], [1], [4])):
        seen, total, reach = abs(sum((w - l) / m for w, l, m in zip(won, lost, n)) / len(n)), 0, 0
        signs = [(1, w + l, m) for w, l, m in zip(won, lost, n)]
        for turned in itertools.product(*[itertools.product((1, -1), repeat=k) for _, k, _ in signs]):
            total += 1
            reach += abs(sum(sum(t) / m for t, (_, _, m) in zip(turned, signs)) / len(n)) >= seen - 1e-12
        assert S.permutation_p(won, lost, n, ("swap", won)) == pytest.approx(reach / total, abs=0.02)


def test_drawn_strata_are_near_the_normal_interval():
    right, n = [300, 80, 45], [400, 200, 50]
    low, high = S.stratified_interval(right, n, "strata")
    mean = np.mean([k / m for k, m in zip(right, n)]) * 100
    spread = math.sqrt(sum(k / m * (1 - k / m) / m for k, m in zip(right, n))) / 3 * 100
    assert (low, high) == pytest.approx((mean - 1.96 * spread, mean + 1.96 * spread), abs=0.15 * spread)
