"""Brute-force neighbours of small fixtures in numpy."""

import numpy as np


def scores(query, base, metric="euclidean"):
    q, b = np.asarray(query, float), np.asarray(base, float)
    if metric == "euclidean":
        return np.sqrt(((b - q) ** 2).sum(axis=1))
    norms = np.sqrt((b**2).sum(axis=1) * (q**2).sum())
    return np.divide(b @ q, norms, out=np.zeros(len(b)), where=norms > 0)


def neighbours(queries, base, k, metric="euclidean", passes=lambda q, b: True):
    """``{qid: [ids]}`` with ties by id; rows are dicts."""
    out = {}
    for q in queries:
        rows = [b for b in base if b["emb"] is not None and passes(q, b)]
        if q["emb"] is None or not rows:
            out[q["qid"]] = []
            continue
        s = scores(q["emb"], [b["emb"] for b in rows], metric)
        keyed = sorted(zip(s if metric == "euclidean" else -s, [b["id"] for b in rows]))
        out[q["qid"]] = [i for _, i in keyed[:k]]
    return out


def collected(ranked):
    """The same shape out of ranked Spark rows."""
    out = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["id"])
    return out
