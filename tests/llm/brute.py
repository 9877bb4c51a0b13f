"""Plain restatements that the operators are held against."""

from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def lower_words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k=5):
    w = lower_words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(nodes, links):
    """node -> least node of its class."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo.extend(near[x])
    return out


def similar(sets, num=80):
    """Pairs of keys whose sets have 100 * common >= num * all."""
    keys = sorted(sets)
    return [
        (a, b)
        for i, a in enumerate(keys)
        for b in keys[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
