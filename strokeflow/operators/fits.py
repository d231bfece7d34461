"""Fits and folds over the few points of one group: homographies, fingerprint clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 by 3 matrix that takes ``src`` to ``dst`` in least squares of normalised coordinates, its last number 1; None for fewer than four points, points on a line, and degenerate ones."""

    def shift(p: np.ndarray) -> np.ndarray:
        middle = p.mean(0)
        radius = np.linalg.norm(p - middle, axis=1).mean()
        s = np.sqrt(2) / radius if radius > 0 else 1.0
        return np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1]])

    def on_line(p: np.ndarray) -> bool:
        spread = np.linalg.svd(p - p.mean(0), compute_uv=False)
        return spread[-1] <= 1e-9 * max(1.0, spread[0])

    if len(src) < 4 or on_line(src) or on_line(dst):
        return None
    ts, td = shift(src), shift(dst)
    one = np.ones(len(src))
    a, b = ts @ np.vstack([src.T, one]), td @ np.vstack([dst.T, one])
    zero = np.zeros((len(src), 3))
    upper, lower = np.hstack([-a.T, zero, (b[0] * a).T]), np.hstack([zero, -a.T, (b[1] * a).T])
    _, singular, v = np.linalg.svd(np.vstack([upper, lower]))
    if singular[7] <= 1e-9 * max(1.0, singular[0]):
        return None
    h = np.linalg.inv(td) @ v[-1].reshape(3, 3) @ ts
    return None if abs(h[2, 2]) <= 1e-12 else h / h[2, 2]


def fit_homographies(points: DataFrame) -> DataFrame:
    """Per run_id the homography (nine numbers, null if there is none) of its landmarks (x, y to u, v), with the root mean square and the largest residual.

    A run has a handful of landmarks; a group is one run's.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)
        h = homography(src, dst)
        if h is None:
            return pd.DataFrame({"run_id": [pdf.run_id.iloc[0]], "h": [None], "rms": [None], "worst": [None]})
        p = h @ np.vstack([src.T, np.ones(len(src))])
        off = np.linalg.norm((p[:2] / p[2]).T - dst, axis=1)
        return pd.DataFrame({"run_id": [pdf.run_id.iloc[0]], "h": [h.ravel().tolist()], "rms": [float(np.sqrt((off**2).mean()))], "worst": [float(off.max())]})

    return points.select("run_id", "x", "y", "u", "v").groupBy("run_id").applyInPandas(fit, "run_id long, h array<double>, rms double, worst double")


def cluster_fingerprints(prints: DataFrame, threshold: float = 0.90, least: int = 3) -> DataFrame:
    """run_id, cluster, i of unit vectors (run_id, i, v), in clusters of ``least`` members or more.

    In the order of i a vector joins the cluster whose mean direction is nearest
    by cosine, the last of equals, if that is ``threshold`` or more, else begins
    one. A group is one run's peaks, a few dozen.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: list[np.ndarray] = []
        members: list[list[int]] = []
        for i, v in pdf.sort_values("i")[["i", "v"]].itertuples(index=False):
            v = np.asarray(v, float)
            near = [float(v @ (s / np.linalg.norm(s))) for s in sums]
            best = max(range(len(near)), key=lambda k: (near[k], k), default=None)
            if best is None or near[best] < threshold:
                sums.append(v.copy())
                members.append([i])
            else:
                sums[best] += v
                members[best].append(i)
        rows = [(pdf.run_id.iloc[0], n, i) for n, m in enumerate(members) if len(m) >= least for i in m]
        return pd.DataFrame(rows, columns=["run_id", "cluster", "i"])

    return prints.select("run_id", "i", "v").groupBy("run_id").applyInPandas(cluster, "run_id long, cluster long, i long")
