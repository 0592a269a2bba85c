"""Plain Python versions of the training-data operators, for small inputs."""

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from cuelattice.llm import kernels as K
from cuelattice.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def dedup_lines(docs, least, short=True):
    """docs: (doc_id, text) with distinct ids, in order -> {doc_id: text} of what stays. short: lines under least go if they are equal."""
    seen, out = [], {}
    for i, t in sorted(docs):
        kept = []
        for line in t.split("\n"):
            if line.strip(" \t\v\f\r") if short else len(line) >= max(2, least):
                late = line in seen or len(line) >= least and any(len(s) >= least and within_one(line, s) for s in seen)
                seen.append(line)
                if late:
                    continue
            kept.append(line)
        text = "\n".join(kept)
        if text == t or text.strip():
            out[i] = text
    return out


def near_pairs(docs, threshold=minhash.THRESHOLD):
    """docs: (doc_id, text) -> (pairs of representatives, pairs of copies)."""
    has, sigs = minhash.signature_rows(pa.array([t for _, t in docs]), minhash.COORDINATES, minhash.SHINGLE, minhash.SEED)
    ids = [i for (i, _), h in zip(docs, has) if h]
    groups = defaultdict(set)
    for i, s in zip(ids, sigs):
        groups[s.tobytes()].add(i)
    reps = {min(g): np.frombuffer(k, np.int32) for k, g in groups.items()}
    pairs = {(a, b): int((reps[a] == reps[b]).sum()) for a, b in combinations(sorted(reps), 2)}
    pairs = {p: n for p, n in pairs.items() if n >= threshold}
    return pairs | {(min(g), x): minhash.COORDINATES for g in groups.values() for x in g if x != min(g)}


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def overlap_words(doc, item, window=13, bad=2):
    d, t, covered = K.words_of(doc), K.words_of(item), set()
    for i in range(len(d) - window + 1):
        for j in range(len(t) - window + 1):
            same = [k for k in range(window) if d[i + k] == t[j + k]]
            if len(same) >= window - bad:
                covered |= {j + k for k in same}
    return len(covered)


def water(budget, caps, weights):
    """Shares by weight, none above its cap: by filling in small rounds."""
    share, live, left = dict.fromkeys(caps, 0.0), set(caps), float(min(budget, sum(caps.values())))
    while live and left > 1e-9:
        total = sum(weights[k] for k in live)
        full = {k for k in live if caps[k] - share[k] <= left * weights[k] / total}
        if not full:
            for k in live:
                share[k] += left * weights[k] / total
            break
        for k in full:
            left -= caps[k] - share[k]
            share[k] = caps[k]
        live -= full
    return share


def ctw_bits(texts, depth):
    """Code lengths of texts by the weighted trees of all of them, by direct recursion over contexts."""
    count = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    steps = []
    for t in texts:
        b = bytes(depth) + t.encode()
        own = []
        for i in range(depth, len(b)):
            node = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                own.append((node, b[i - depth : i], bit))
                for d in range(depth + 1):
                    count[node, b[i - d : i]][bit] += 1
                    if d:
                        kids[node, b[i - d + 1 : i]].add((node, b[i - d : i]))
                node = node * 2 + bit
        steps.append(own)

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*count[key])
            memo[key] = own if len(key[1]) == depth else np.logaddexp(own, sum(weighted(c) for c in kids[key])) - math.log(2)
        return memo[key]

    def one(node, context, d):
        key = (node, context[depth - d :])
        z, o = count[key]
        p = (o + 0.5) / (z + o + 1)
        if d == depth:
            return p
        stop = math.exp(kt(z, o) - math.log(2) - weighted(key))
        return stop * p + (1 - stop) * one(node, context, d + 1)

    return [sum(-math.log2(one(n, c, 0) if bit else 1 - one(n, c, 0)) for n, c, bit in own) for own in steps]
