"""Slow, direct computations on small tables, used as an independent check."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd

METRICS = [("l2", "log", -1.0), ("cosim", "fisher", 1.0), ("kl", "log", -1.0), ("js", "log", -1.0)]


def make_table(seed: int = 3, devices: int = 7, subdirs=("deep", "wide")) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Item table, task labels and overall labels with holes: a missing item, an unlabelled device, an item only one device has."""
    rng = np.random.default_rng(seed)
    rows, labels, overall = [], [], []
    for d in range(devices):
        q = d / (devices - 1)
        for s in subdirs:
            items = ["0"] if s == "wide" and d == 2 else ["0", "1", "2"]
            if d == 1:
                items = [i for i in items if i != "1"]
            if d == 3 and s == "deep":
                items.append("only3")
            for x in items:
                rows.append(dict(
                    name=f"d{d}", subdir=s, x=x, n_windows=int(rng.integers(2, 18)),
                    l2_mean=6 - 3.8 * q + 0.3 * rng.normal(), l2_var=rng.uniform(0.01, 0.15),
                    cosim_mean=float(np.clip(0.2 + 0.6 * q + 0.1 * rng.normal(), -0.9, 0.95)), cosim_var=rng.uniform(0.0002, 0.005),
                    kl_mean=abs(2 - q + 0.5 * rng.normal()), kl_var=rng.uniform(0.01, 0.2), js_mean=abs(0.4 - 0.2 * q + 0.1 * rng.normal()), js_var=rng.uniform(0.001, 0.02)))
            if not (d == devices - 1 and s == "wide"):
                labels.append(dict(name=f"d{d}", subdir=s, human_score=50 + 30 * q + 4 * rng.normal()))
        overall.append(dict(name=f"d{d}", overall_human_score=50 + 30 * q + 3 * rng.normal()))
    return pd.DataFrame(rows), pd.DataFrame(labels), pd.DataFrame(overall)


def stable(df: pd.DataFrame) -> pd.DataFrame:
    out = df.copy()
    out["eff"] = np.maximum(1, (df.n_windows + 4) / 5)
    for key, kind, _ in METRICS:
        m, v = df[f"{key}_mean"], df[f"{key}_var"]
        out[f"t_{key}"] = np.log1p(m) if kind == "log" else np.arctanh(m)
        out[f"v_{key}"] = v / (1 + m) ** 2 if kind == "log" else v / (1 - m**2) ** 2
    return out


def center_scale(v) -> tuple[float, float]:
    v = np.asarray(v, float)
    c = np.median(v)
    mad = 1.4826 * np.median(np.abs(v - c))
    if mad > 1e-8:
        return c, mad
    if len(v) > 1:
        iqr = np.subtract(*np.percentile(v, [75, 25])) / 1.349
        if iqr > 1e-8:
            return c, iqr
        if v.std(ddof=1) > 1e-8:
            return c, v.std(ddof=1)
    return c, 1.0


def aggregate(fit: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Device features of ``rows`` (one subdir) under the normalisation of ``fit``."""
    fit, rows = stable(fit), stable(rows)
    expected = fit.x.nunique()
    out = []
    for name, g in rows.groupby("name"):
        rec = {"name": name, "n": len(g)}
        for key, _, sign in METRICS:
            q, se = [], []
            for r in g.itertuples():
                same = fit[fit.x == r.x]
                c, s = center_scale((same if len(same) else fit)[f"t_{key}"])
                q.append(sign * (getattr(r, f"t_{key}") - c) / s)
                se.append(np.sqrt(getattr(r, f"v_{key}") / r.eff) / s)
            q, se = np.array(q), np.array(se)
            std = q.std(ddof=1) if len(q) > 1 else np.nan
            total = np.sqrt((se**2).sum() / len(q) ** 2 + (std**2 / len(q) if len(q) > 1 else 0))
            rec |= {f"{key}_quality_mean": q.mean(), f"{key}_quality_median": np.median(q), f"{key}_stability_quality": -std, f"{key}_uncertainty_quality": -total}
        cov = min(1.0, g.x.nunique() / expected)
        rec["w"] = float(np.clip(np.sqrt(min(len(g), 3) / 3) * np.sqrt(cov), 0.25, 1))
        out.append(rec)
    return pd.DataFrame(out).set_index("name")


def percentile(v: pd.Series) -> pd.Series:
    return 100 * (v.rank(method="average") - 0.5) / len(v)


def nonneg_ridge(f: pd.DataFrame, y, w, alpha: float):
    """Exact minimum by trying every support."""
    f = f.astype(float)
    med = f.median().fillna(0.0)
    filled = f.fillna(med)
    mean, sd = filled.mean(), filled.std(ddof=0)
    sd = sd.where(sd > 1e-12, 1.0)
    z = ((filled - mean) / sd).to_numpy()
    y, w = np.asarray(y, float), np.asarray(w, float)
    w = w / w.mean()
    xc, yc = np.average(z, axis=0, weights=w), np.average(y, weights=w)
    a, b = z - xc, y - yc
    gram, rhs = a.T @ (w[:, None] * a) + alpha * np.eye(z.shape[1]), a.T @ (w * b)
    best, coef = np.inf, None
    for size in range(z.shape[1] + 1):
        for on in itertools.combinations(range(z.shape[1]), size):
            trial = np.zeros(z.shape[1])
            if on:
                trial[list(on)] = np.linalg.solve(gram[np.ix_(on, on)], rhs[list(on)])
            if (trial < -1e-12).any():
                continue
            value = trial @ gram @ trial / 2 - rhs @ trial
            if value < best - 1e-12:
                best, coef = value, trial
    icpt = yc - xc @ coef

    def predict(rows: pd.DataFrame):
        return icpt + ((rows[f.columns].astype(float).fillna(med) - mean) / sd).to_numpy() @ coef

    return predict
