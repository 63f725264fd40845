"""Plain-Python answers on small inputs, written from the rules themselves."""

from __future__ import annotations

import numpy as np


def grams(text):
    return {text[k : k + 2] for k in range(len(text) - 1)}


def dice(a, b):
    a, b = grams(a.lower()), grams(b.lower())
    if not a and not b:
        return 1.0
    return 2 * len(a & b) / (len(a) + len(b))


def best_window(body, phrase, threshold):
    body, phrase = body.lower(), phrase.lower()
    best, at = 0.0, -1
    for k in range(len(body) - len(phrase) + 1):
        if k and body[k - 1] not in " \n":
            continue
        d = dice(phrase, body[k : k + len(phrase)])
        if d > best:
            best, at = d, k
    return (at, best) if best >= threshold and at >= 0 else None


def keyword(sources, targets, threshold=0.8, max_new=10):
    """sources: id -> (project, body, links); targets: id -> (project, key, phrase)."""
    rows = set()
    for sid, (project, body, links) in sources.items():
        taken = 0
        for tid in sorted(targets):
            tp, key, phrase = targets[tid]
            if tp != project or tid == sid or key in links or taken == max_new:
                continue
            at = body.lower().find(phrase)
            hit = (at, 1.0) if at >= 0 else best_window(body, phrase, threshold)
            if hit:
                rows.add((sid, tid, hit[0], round(hit[1], 9)))
                taken += 1
    return rows


def neighbours(vectors, k, threshold):
    """vectors: (project, id, list) rows -> {(source, target, rank)}."""
    out = set()
    for p, i, v in vectors:
        v = np.array(v)
        found = []
        for q, j, u in vectors:
            if p == q and i != j:
                u = np.array(u)
                s = round(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), 9)
                if s >= threshold:
                    found.append((-s, j))
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(sorted(found)[:k])}
    return out
