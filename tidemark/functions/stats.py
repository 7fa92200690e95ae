"""Statistics of one series or window at a time, as Spark hands them to a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def mahalanobis(frame: pd.DataFrame) -> pd.DataFrame:
    """Distances from a robust centre: the half of the rows with the smallest covariance, by concentration steps."""
    x = frame[["a", "b", "c"]].to_numpy(float)
    half = (len(x) + x.shape[1] + 1) // 2
    rng = np.random.default_rng(5)
    best: tuple[float, np.ndarray] | None = None
    for _ in range(20):
        keep = rng.choice(len(x), x.shape[1] + 1, replace=False)
        for _ in range(15):
            mean, cov = x[keep].mean(0), np.cov(x[keep].T) + np.eye(x.shape[1]) * 1e-9
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            keep = np.argsort(d, kind="stable")[:half]
        det = np.linalg.det(np.cov(x[keep].T))
        if best is None or det < best[0]:
            best = (det, keep)
    mean, cov = x[best[1]].mean(0), np.cov(x[best[1]].T)
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    d *= 2.366 / np.median(d)  # the median of chi-square with three degrees of freedom
    return pd.DataFrame({"month": frame["month"], "d": frame["d"], "distance": np.round(d, 6)})


#: How strongly spend follows revenue; days of cover and of delivery of the stock rule.
KAPPA, COVER, LEAD = 0.3, 10, 3


def endogenous_spend(frame: pd.DataFrame) -> pd.DataFrame:
    """Planned spend moved by last week's revenue against its target (the mean so far), and by noise."""
    f = frame.sort_values("week").reset_index(drop=True)
    revenue, spend = f["revenue"].to_numpy(float), []
    planned = 0.05 * revenue.mean()
    for w in range(len(f)):
        gap = revenue[w - 1] / revenue[:w].mean() - 1 if w else 0.0
        spend.append(round(planned * (1 + KAPPA * gap) * float(np.exp(0.05 * f["z"][w])), 4))
    return pd.DataFrame({"channel": f["channel"], "week": f["week"], "spend": spend})


def inventory(frame: pd.DataFrame) -> pd.DataFrame:
    """Orders fill stock up to COVER days of the mean and arrive after LEAD days."""
    f = frame.sort_values("t").reset_index(drop=True)
    need = f["units"].to_numpy(np.int64)
    target = int(np.ceil(need.mean() * COVER))
    stock, coming, rows = target, [0] * LEAD, []
    for units in need.tolist():
        stock += coming.pop(0)
        sold = min(stock, units)
        stock -= sold
        rows.append((stock, sold, units - sold))
        coming.append(max(0, target - stock - sum(coming)))
    out = pd.DataFrame(rows, columns=["stock", "sold", "short"])
    return pd.concat([f[["sku", "region", "t"]], out], axis=1)


def discover_periods(y: np.ndarray, longest: int | None = None) -> list[int]:
    """Periods at peaks of the periodogram that autocorrelation confirms; none is assumed."""
    n = len(y)
    x = y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n))
    power = np.abs(np.fft.rfft(x)) ** 2
    longest = min(longest or n // 3, n // 3)
    found: list[int] = []
    for k in np.argsort(-power)[:10]:
        if k == 0 or power[k] < 6 * np.median(power[1:]):
            continue
        p = round(n / k)
        if not 2 <= p <= longest or any(abs(p - q) <= 1 for q in found):
            continue
        acf = float((x[p:] * x[:-p]).sum() / (x * x).sum())
        if acf > 2 / np.sqrt(n):
            found.append(p)
    return sorted(p for p in found if not any(q != p and q % p == 0 and q < p for q in found))


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    kernel = np.ones(n) / n if n % 2 else np.r_[0.5, np.ones(n - 1), 0.5] / n
    half = len(kernel) // 2
    return np.convolve(np.r_[np.full(half, y[:n].mean()), y, np.full(half, y[-n:].mean())], kernel, "valid")


def mstl(frame: pd.DataFrame) -> pd.DataFrame:
    """Trend, sum of seasonal parts and remainder, by turns over the discovered periods."""
    f = frame.sort_values("t").reset_index(drop=True)
    y = f["y"].to_numpy(float)
    periods = discover_periods(y)
    seasonal = {p: np.zeros(len(y)) for p in periods}
    trend = _moving(y, max(periods, default=7))
    for _ in range(3):
        for p in periods:
            rest = y - trend - sum(s for q, s in seasonal.items() if q != p)
            index = np.array([rest[k::p].mean() for k in range(p)])
            seasonal[p] = (index - index.mean())[np.arange(len(y)) % p]
        trend = _moving(y - sum(seasonal.values()), max(periods, default=7))
    total = sum(seasonal.values()) if seasonal else np.zeros(len(y))
    return pd.DataFrame({"region": f["region"], "t": f["t"], "trend": np.round(trend, 6), "seasonal": np.round(total, 6), "remainder": np.round(y - trend - total, 6)})


def chi2_tail(x: float, k: int) -> float:
    """The chance of a chi-square value above x with k degrees of freedom, k even."""
    term = total = np.exp(-x / 2)
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return float(total)


#: Lags of the test for what correlation is left, and the longest memory that is tried.
TESTED, MEMORY = 10, 7


def ljung_box(e: np.ndarray, lags: int = TESTED) -> float:
    """p of no correlation at all lags up to ``lags``."""
    n, x = len(e), e - e.mean()
    if n <= lags + 1 or not (x * x).sum():
        return 1.0
    acf = np.array([(x[k:] * x[:-k]).sum() for k in range(1, lags + 1)]) / (x * x).sum()
    return chi2_tail(float(n * (n + 2) * (acf**2 / (n - np.arange(1, lags + 1))).sum()), lags)


def innovations(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of an autoregression of order p by least squares, and what it leaves; the first p values aren't left."""
    x = y - y.mean()
    if not p:
        return np.zeros(0), x
    lags = np.column_stack([x[p - k : len(x) - k] for k in range(1, p + 1)])
    phi = np.linalg.lstsq(lags, x[p:], rcond=None)[0]
    return phi, x[p:] - lags @ phi


def whiten(frame: pd.DataFrame) -> pd.DataFrame:
    """The shortest memory whose innovations show no correlation, or that of the least AIC if none does."""
    f = frame.sort_values("t").reset_index(drop=True)
    y = f["y"].to_numpy(float)
    tried = []
    for p in range(min(MEMORY, max(0, len(y) // 3 - 1)) + 1):
        _, e = innovations(y, p)
        left = ljung_box(e)
        tried.append((len(e) * np.log(max(float((e * e).mean()), 1e-300)) + 2 * p, p, left, e))
        if left > 0.05:
            break
    aic, p, left, e = tried[-1] if tried[-1][2] > 0.05 else min(tried, key=lambda x: x[:2])
    return pd.DataFrame({"series": f["series"][p:], "t": f["t"][p:], "p": p, "ljung_box": round(left, 6), "e": np.round(e, 6)})


DRIVERS = ("price", "discount", "breadth")


def drivers(frame: pd.DataFrame) -> pd.DataFrame:
    """Slopes of y on several drivers, twice: least squares with errors that allow for correlation (Newey and West), and
    after taking first-order correlation out. They agree where signs are equal and the two lie within two such errors."""
    f = frame.sort_values("t")
    y = f["y"].to_numpy(float)
    x = np.column_stack([np.ones(len(f)), f[list(DRIVERS)].to_numpy(float)])
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    u = y - x @ beta
    lags = int(4 * (len(y) / 100) ** (2 / 9))
    xu = x * u[:, None]
    meat = xu.T @ xu
    for k in range(1, lags + 1):
        g = xu[k:].T @ xu[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    se = np.sqrt(np.clip(np.diag(inv @ meat @ inv), 0, None))
    rho, other = 0.0, beta
    for _ in range(50):
        v = y - x @ other
        new = float((v[1:] * v[:-1]).sum() / max((v[:-1] ** 2).sum(), 1e-300))
        other = np.linalg.lstsq(x[1:] - new * x[:-1], y[1:] - new * y[:-1], rcond=None)[0]
        if abs(new - rho) < 1e-9:
            break
        rho = new
    rows = []
    for i, name in enumerate(DRIVERS, 1):
        rest = np.delete(x, i, axis=1)
        left = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        spread = ((x[:, i] - x[:, i].mean()) ** 2).sum()
        vif = spread / max((left**2).sum(), 1e-300)
        agree = beta[i] * other[i] > 0 and abs(beta[i] - other[i]) <= 2 * se[i]
        rows.append((frame["region"].iloc[0], name, round(beta[i], 6), round(se[i], 6), round(other[i], 6), round(rho, 6), round(vif, 6), bool(agree), bool(vif > 5)))
    return pd.DataFrame(rows, columns=["region", "driver", "beta", "hac_se", "gls_beta", "rho", "vif", "agree", "collinear"])


def cochrane_orcutt(frame: pd.DataFrame) -> pd.DataFrame:
    """A slope with AR(1) errors within each series, by turns until the error's coefficient settles."""
    f = frame.sort_values(["sku", "channel", "t"])
    x, y, t = f["x"].to_numpy(float), f["y"].to_numpy(float), f["t"].to_numpy()
    follows = np.r_[False, (t[1:] == t[:-1] + 1)]
    beta, rho = float((x * y).sum() / (x * x).sum()), 0.0
    for _ in range(50):
        u = y - beta * x
        new = float((u[1:] * u[:-1])[follows[1:]].sum() / (u[:-1] ** 2)[follows[1:]].sum())
        xs, ys = (x[1:] - new * x[:-1])[follows[1:]], (y[1:] - new * y[:-1])[follows[1:]]
        beta = float((xs * ys).sum() / (xs * xs).sum())
        if abs(new - rho) < 1e-9:
            break
        rho = new
    return pd.DataFrame({"region": [frame["region"].iloc[0]], "beta": [round(beta, 6)], "rho": [round(rho, 6)], "n": [len(f)]})


#: Smoothing of the chance of a sale and of its size.
CHANCE, SIZE = 0.2, 0.2


def tsb(frame: pd.DataFrame) -> pd.DataFrame:
    """Chance and size of demand after the last month, as of the first month to the last of the product."""
    seen = dict(zip(frame["t"].tolist(), frame["units"].tolist(), strict=True))
    first, last = min(seen), max(seen)
    chance, size = len(seen) / (last - first + 1), float(np.mean(list(seen.values())))
    for t in range(first, last + 1):
        if t in seen:
            chance += CHANCE * (1 - chance)
            size += SIZE * (seen[t] - size)
        else:
            chance -= CHANCE * chance
    return pd.DataFrame({"sku": [frame["sku"].iloc[0]], "chance": [round(chance, 6)], "size": [round(size, 6)], "forecast": [round(chance * size, 6)]})


#: Cells (products by months) that are smoothed at once.
CELLS = 1 << 20


def tsb_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tsb`` of many products, each a row: sku, t (months in order) and units of these months; the same numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        every = batch.column("t")
        ends, values = every.offsets.to_numpy(), every.values.to_numpy()
        first, last = values[ends[:-1]].astype(np.int64), values[ends[1:] - 1].astype(np.int64)
        step = max(1, CELLS // int((last - first).max(initial=0) + 1))
        for k in range(0, batch.num_rows, step):
            part, low, span = batch.slice(k, step), first[k : k + step], (last - first)[k : k + step] + 1
            months, units = part.column("t"), part.column("units")
            n = np.diff(months.offsets.to_numpy())
            row, t, u = np.repeat(np.arange(len(n)), n), months.flatten().to_numpy(), units.flatten().to_numpy()
            sold, amount = np.zeros((int(span.max()), len(n)), bool), np.zeros((int(span.max()), len(n)))
            sold[t - low[row], row], amount[t - low[row], row] = True, u
            chance, size = n / span, np.bincount(row, u, len(n)) / n
            for m in range(len(sold)):
                there, now = span > m, sold[m]
                chance = np.where(now, chance + CHANCE * (1 - chance), np.where(there, chance - CHANCE * chance, chance))
                size = np.where(now, size + SIZE * (amount[m] - size), size)
            columns = [[round(x, 6) for x in c.tolist()] for c in (chance, size, chance * size)]
            yield pa.RecordBatch.from_arrays([part.column("sku"), *map(pa.array, columns)], ["sku", "chance", "size", "forecast"])
