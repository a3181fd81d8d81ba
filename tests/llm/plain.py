"""Plain versions of operators, in Python and numpy alone."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np


def sample(ids, keys_of, weights, known_good, missed=0.002):
    """The ids of the importance sample: as many of the largest keys as weigh what all but ``missed`` of the unseen good ones do."""
    own = sorted((weights[i] for i in known_good if i in weights), reverse=True)
    k = sum(weights[i] >= own[len(own) - int(missed * len(own)) - 1] for i in ids) if own else len(ids)
    return set(sorted(ids, key=keys_of.get, reverse=True)[:k])


def log_weights(grams, target, buckets, prior=20):
    """id -> log importance weight, from id -> buckets of its n-grams and the ids of target documents."""
    seen = np.zeros((2, buckets))
    for i, found in grams.items():
        np.add.at(seen[0], found, 1)
        if i in target:
            np.add.at(seen[1], found, 1)
    p = (seen[0] + 1) / (seen[0] + 1).sum()
    q = (seen[1] + prior * buckets * p) / (seen[1].sum() + prior * buckets)
    ratio = np.log(q) - np.log(p)
    return {i: ratio[found].sum() for i, found in grams.items()}


def _drawn(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def mix(rows, weights=(5, 2, 1), share=1.5, ceiling=2.0, seed=17):
    """id -> copies, from (id, source, text): targets by sharing again and again, then prefix sums of expected copies. For up to 20,000 rows of a class."""
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    by = defaultdict(list)
    for i, source, _ in rows:
        by[source].append(i)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total = {s: sum(sizes[i] for i in by[s]) for s in order}
    pool, open_, target = share * sum(total.values()), set(order), {}
    while open_:
        each = pool / sum(w[s] for s in open_)
        full = {s for s in open_ if each * w[s] > ceiling * total[s]}
        if not full:
            target |= {s: each * w[s] for s in open_}
            break
        for s in full:
            target[s] = ceiling * total[s]
            pool -= target[s]
        open_ -= full
    out = {}
    for s in order:
        rate, offset = (target[s] / total[s] if total[s] else 0.0), _drawn(f"{seed}/offset/{chr(0) + 'null' if s is None else s}") / 2**32

        def place(i):
            n = sizes[i]
            top = n.bit_length() - 1
            return (n if n < 16 else top * 8 + n * 8 // 2**top - 8 + 100), n, i

        for k, i in enumerate(sorted(by[s], key=place)):
            out[i] = math.floor(rate * (k + 1) + offset) - math.floor(rate * k + offset)
    return out
