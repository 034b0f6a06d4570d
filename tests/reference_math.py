"""Independent numpy re-computation of the scores and information values, for tests only."""

import itertools
from statistics import NormalDist

import numpy as np
import pandas as pd

ppf = np.vectorize(NormalDist().inv_cdf)


def normal_scores(x):
    ranks = pd.Series(np.asarray(x, dtype=np.float32)).fillna(np.inf).rank(method="average").to_numpy()
    return ppf((ranks - 0.5) / len(ranks))


def power(x):
    return np.sign(x) * np.abs(x) ** 1.5


def corr(t, p):
    a, b = power(t - t.mean()), power(normal_scores(p))
    if a.std() == 0 or b.std() == 0:
        return np.nan
    return float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))


def mmc(t, p, m):
    a, b, c = t - t.mean(), normal_scores(p), normal_scores(m)
    if (c @ c) == 0:
        return np.nan
    rest = b - (b @ c) / (c @ c) * c
    return float(4 * ((a - a.mean()) * (rest - rest.mean())).mean())


def payoff(t, p, m):
    return 0.5 * corr(t, p) + 2 * mmc(t, p, m)


def ensemble(columns):
    z = [normal_scores(c) for c in columns]
    z = [c / c.std() for c in z]
    return np.round(np.mean(z, axis=0), 12) + 0.0


def information(x, y):
    """Pair tables (mi, cmi) and relevance by direct sums over cells."""
    n, j = x.shape
    rel = np.array([_mi(x[:, a], y) for a in range(j)])
    mi = np.array([[_mi(x[:, a], x[:, b]) for b in range(j)] for a in range(j)])
    cmi = np.zeros((j, j))
    for a, b in itertools.product(range(j), repeat=2):
        for k in np.unique(y):
            s = y == k
            cmi[a, b] += s.mean() * _mi(x[s, a], x[s, b])
    return mi, cmi, rel


def _mi(u, v):
    total = 0.0
    for a, b in set(zip(u.tolist(), v.tolist())):
        p = ((u == a) & (v == b)).mean()
        total += p * np.log(p / ((u == a).mean() * (v == b).mean()))
    return total


def greedy(mi, cmi, rel, method):
    """Objective written out over the whole selected set at every step."""
    chosen = [int(np.argmax(rel))]
    while len(chosen) < len(rel):
        best, best_value = None, -np.inf
        for c in range(len(rel)):
            if c in chosen:
                continue
            gain = [mi[c, s] - cmi[c, s] for s in chosen]
            value = {
                "CIFE": lambda: rel[c] - sum(gain),
                "JMI": lambda: rel[c] - np.mean(gain),
                "CMIM": lambda: rel[c] - max(gain),
                "JMIM": lambda: rel[c] - max(g - rel[s] for g, s in zip(gain, chosen)),
                "DMIM": lambda: rel[c] - max(mi[c, s] for s in chosen) + max(cmi[c, s] for s in chosen),
            }[method]()
            if value > best_value + 1e-15:
                best, best_value = c, value
        chosen.append(best)
    return chosen
