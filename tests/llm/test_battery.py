"""The parts of the randomness battery against plain versions: statistics by counting, moments and tails by enumeration,
false-discovery control by the rule on single p-values."""

import itertools
import math
import random

import numpy as np
import pytest

from tidemark.llm import secrets


def plain_battery(token):
    enc = next(i for i, a in enumerate(secrets.ENCODINGS) if all(c in a for c in token))
    x = [secrets.ENCODINGS[enc].index(c) for c in token]
    n, half = len(x), len(secrets.ENCODINGS[enc]) / 2
    same = sum(a == b for a, b in itertools.combinations(x, 2))
    high = [v >= half for v in x]
    runs = len(list(itertools.groupby(high)))
    up, down = sum(high), n - sum(high)
    if up and down:
        mean = 1 + 2 * up * down / n
        var = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
        z_runs = (runs - mean) / math.sqrt(var) if var > 0 else 0.0
    else:
        z_runs = -math.inf
    m = sum(x) / n
    total = sum((v - m) ** 2 for v in x)
    z_serial = sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / total * math.sqrt(n) if total else math.inf
    return enc, same, z_runs, z_serial


@pytest.mark.parametrize("alphabet", range(len(secrets.ENCODINGS)))
def test_statistics_by_counting(alphabet):
    rng = random.Random(alphabet)
    for n in (20, 24, 33, 64):
        for _ in range(5):
            token = "".join(rng.choice(secrets.ENCODINGS[alphabet]) for _ in range(n))
            got, want = secrets.battery(token), plain_battery(token)
            assert got[:2] == want[:2] and got[2:] == pytest.approx(want[2:])
    assert secrets.battery("0" * 20)[:2] == (0, 190) and secrets.battery("0" * 20)[2:] == (-math.inf, math.inf)
    # the chi-squared statistic for uniformity is a linear function of the coincidences at a given length
    size = len(secrets.ENCODINGS[alphabet])
    chi = []
    for _ in range(3):
        x = [rng.randrange(size) for _ in range(30)]
        same = sum(a == b for a, b in itertools.combinations(x, 2))
        chi.append(sum((x.count(k) - 30 / size) ** 2 / (30 / size) for k in range(size)) - (2 * same + 30) * size / 30)
    assert chi == pytest.approx([-30.0] * 3)


@pytest.mark.parametrize("share", [[0.5, 0.5], [0.7, 0.2, 0.1], [0.4, 0.3, 0.2, 0.1]])
def test_moments_and_tails_by_enumeration(share):
    share, n = np.array(share), 6
    strings = list(itertools.product(range(len(share)), repeat=n))
    weight = [math.prod(share[c] for c in s) for s in strings]
    same = [sum(a == b for a, b in itertools.combinations(s, 2)) for s in strings]
    mean = sum(w * c for w, c in zip(weight, same))
    var = sum(w * (c - mean) ** 2 for w, c in zip(weight, same))
    for seen in range(16):
        want = 0.5 * math.erfc(-(seen + 0.5 - mean) / math.sqrt(2 * var))
        assert secrets.p_value(n, seen, share) == pytest.approx(want)
    # the bound on surprise: Chernoff's at each step, never below the exact tail
    logs = np.log(share)
    growth = np.log(np.exp(np.multiply.outer(1 - secrets.STEPS, logs)).sum(1))
    surprise = [-sum(logs[c] for c in s) for s in strings]
    for s, x in zip(strings[::37], surprise[::37]):
        hist = np.bincount(s, minlength=len(share))
        got = secrets.surprise_p(hist, logs, growth)
        moments = [sum(p * math.exp(-t * math.log(p)) for p in share) ** n * math.exp(-t * x) for t in secrets.STEPS]
        assert got == pytest.approx(min(1.0, *moments))
        assert got >= sum(w for w, y in zip(weight, surprise) if y >= x - 1e-12) - 1e-12


@pytest.mark.parametrize("seed", range(6))
def test_false_discovery_control_on_single_values(seed):
    rng = random.Random(seed)
    rows = {}
    for _ in range(400):
        key = (rng.randrange(3), min(40, int(rng.expovariate(0.25 if rng.random() < 0.7 else 0.05))))
        rows[key] = rows.get(key, 0) + 1
    got = secrets.thresholds([(b, k, n) for (b, k), n in rows.items()], 0.05)
    for band in range(3):
        p = sorted(10 ** (-k / secrets.BIN) for (b, k), n in rows.items() if b == band for _ in range(n))
        last = max((i for i, v in enumerate(p, 1) if v <= 0.05 * i / len(p)), default=0)
        kept = {k for (b, k) in rows if b == band and last and k and 10 ** (-k / secrets.BIN) <= p[last - 1]}
        assert {k for (b, k) in rows if b == band and k >= got.get(band, 10**9)} == kept
    assert secrets.thresholds([]) == {}


def test_kinds_of_characters():
    rng = random.Random(8)
    enc = secrets.ENCODINGS.index(secrets.ENCODINGS[-2])
    draw = lambda n: "".join(rng.choice(secrets.ENCODINGS[enc]) for _ in range(n)).encode()
    assert sum(secrets.kinds_like_random(draw(32), enc) for _ in range(500)) > 480
    assert not any(secrets.kinds_like_random(t, enc) for t in (b"ThisIsOneCamelCaseNameOfLongClass", b"thenameofallthingsthatare1A", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaA1"))
