"""Distribution functions in plain Python, for a handful of numbers on the driver."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _bisect(f, lo: float, hi: float, target: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def normal_ppf(p: float) -> float:
    return _bisect(normal_cdf, -40, 40, p)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, else Lentz's continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, dof: float) -> float:
    tail = 0.5 * beta_inc(dof / 2, 0.5, dof / (dof + t * t))
    return tail if t >= 0 else 1 - tail


def t_ppf(p: float, dof: float) -> float:
    return _bisect(lambda t: 1 - t_sf(t, dof), -1e6, 1e6, p)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    return 1.0 if k >= n else 1 - beta_inc(k + 1, n - k, p)


def binomial_ppf(q: float, n: int, p: float) -> int:
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if binomial_cdf(mid, n, p) >= q else (mid + 1, hi)
    return lo


def kolmogorov_sf(x: float) -> float:
    """P(K > x) of the limiting distribution."""
    if x < 1e-8:
        return 1.0
    if x < 1:
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 30))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * total)
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 30)))


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def inverse_digamma_gap(gap: float) -> float:
    """a with log(a) - digamma(a) = gap: the shape of a gamma distribution whose mean and mean logarithm lie so far apart."""
    gap = max(gap, 1e-12)
    a = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        new = a - (math.log(a) - digamma(a) - gap) / (1 / a - trigamma(a))
        new = a / 2 if new <= 0 else new
        if abs(new - a) <= 1e-12 * a:
            return new
        a = new
    return a


def beta_shapes(log_mean: float, log_rest: float, mean: float, variance: float) -> tuple[float, float]:
    """The maximum-likelihood shapes of a beta distribution from the mean logarithms of x and 1 - x."""
    size = max(mean * (1 - mean) / variance - 1, 1e-3)
    a, b = mean * size, (1 - mean) * size
    for _ in range(200):
        both, both1 = digamma(a + b), trigamma(a + b)
        f, g = digamma(a) - both - log_mean, digamma(b) - both - log_rest
        p, q = trigamma(a) - both1, trigamma(b) - both1
        det = p * q - both1 * both1
        da, db = (f * q + g * both1) / det, (g * p + f * both1) / det
        step = 1.0
        while a - step * da <= 0 or b - step * db <= 0:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(da) <= 1e-10 * a and abs(db) <= 1e-10 * b:
            break
    return a, b
