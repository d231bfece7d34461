"""Plain forms of operators, for small fixtures."""

from __future__ import annotations

import re


def jaccard_components(texts: dict[int, str | None], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id), pair by pair."""
    sets = {}
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    parent = {d: d for d in texts}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
