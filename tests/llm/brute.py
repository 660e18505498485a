"""Plain Python versions of what the operators compute."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def reach(nodes, links):
    """node -> smallest node reachable."""
    to = {n: n for n in nodes}

    def find(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_links(texts, width, percent):
    """Links between the ids of a dict of texts."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    shared = defaultdict(int)
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for ids in by.values():
        for a, b in combinations(ids, 2):
            shared[a, b] += 1
    return sets, [(a, b) for (a, b), k in shared.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]


def forward(net, text, size):
    """Language and probability of a text, window by window and filter by filter; None for texts without a letter."""
    if not any(c.isalpha() for c in text or ""):
        return None
    data = text.encode()
    total = np.zeros(len(net.langs))
    for at in range(0, len(data), size):
        window = data[at : at + size]
        e = net.embed[list(window.ljust(size, b"\0"))]
        pooled = [max((e[i : i + len(k)] * k[:, :, f]).sum() for i in range(size - len(k) + 1)) for k in net.filters for f in range(k.shape[2])]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        total += len(window) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
    p = np.exp(total / len(data) - (total / len(data)).max())
    return net.langs[int(p.argmax())], float((p / p.sum()).max())


def kneser_ney(counts, order, d):
    """A function (class, history, character) -> probability from counts of (history, character) by class, and the characters."""
    seen = counts[0].keys() | counts[1].keys()
    types = {k: {(h[len(h) - k :], x) for h, x in seen if len(h) >= k} for k in range(1, order)}
    cont = [Counter((h[1:], x) for h, x in types[k + 1]) for k in range(order - 1)]
    letters = {x for _, x in cont[0]}

    def mixed(n, total, kinds, lower):
        return (max(n - d, 0) + d * kinds * lower) / total if total else lower

    def lower(h, x):
        of = cont[len(h)]
        rest = lower(h[1:], x) if h else 1 / (len(letters) + 1)
        return mixed(of[h, x], sum(n for (g, _), n in of.items() if g == h), sum(g == h for g, _ in of), rest)

    totals = [defaultdict(int), defaultdict(int)]
    kinds = [defaultdict(int), defaultdict(int)]
    for c in (0, 1):
        for (h, _), n in counts[c].items():
            totals[c][h] += n
            kinds[c][h] += 1
    return lambda c, h, x: mixed(counts[c][h, x], totals[c][h], kinds[c][h], lower(h[1:], x)), letters


def lines_kept(docs, near_chars):
    """doc_id -> text with the lines gone that equal, or are an edit from, an earlier line."""
    first, order = {}, []
    for d in sorted(docs):
        for n, line in enumerate((docs[d] or "").split("\n")):
            s = line.strip(" ")
            if s and s not in first:
                first[s] = (d, n)
                order.append(s)

    def edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    near = {b for j, b in enumerate(order) if len(b) >= near_chars for a in order[:j] if len(a) >= near_chars and edit(a, b)}
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" ") or (first[x.strip(" ")] == (d, n) and x.strip(" ") not in near)) for d, t in docs.items()}


def spoken(net, text, size):
    """Language and probability of a text, by convolutions over all its windows at once."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    data = text.encode()
    n = -(-len(data) // size)
    e = net.embed[np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)]
    pooled = np.concatenate([np.einsum("nsdw,wdf->nsf", np.lib.stride_tricks.sliding_window_view(e, len(k), axis=1), k).max(axis=1) for k in net.filters], axis=1)
    z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
    z -= z.max(axis=1, keepdims=True)
    weights = np.full(n, size)
    weights[-1] = len(data) - size * (n - 1)
    total = weights @ (z - np.log(np.exp(z).sum(axis=1, keepdims=True))) / len(data)
    p = np.exp(total - total.max())
    return net.langs[int(p.argmax())], float(p.max() / p.sum())


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """source -> words to take: by weight, none over its limit, the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in weight if s not in full)
        goal = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in weight}
        over = {s for s in goal if s not in full and goal[s] > most * sizes[s]}
        if not over:
            return goal
        full |= over
