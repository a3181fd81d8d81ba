"""Packing, the filter audit and centroid clustering: against plain versions and SQL, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tests.compare import check, connect
from timberline.llm import clusters, filter_audit, packing

SF = "/root/testdata/sf0.001"


# --- packing ---------------------------------------------------------------------------------------------------------


def fewest(sizes, room):
    """The least number of sequences, by trying all."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, spaces):
        if len(spaces) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(spaces)
            return
        for space in {s for s in spaces if s >= sizes[i]}:
            k = spaces.index(space)
            go(i + 1, [*spaces[:k], space - sizes[i], *spaces[k + 1 :]])
        go(i + 1, [*spaces, room - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(5)
    fixed_any = 0
    for _ in range(600):
        room, n = rng.choice([10, 16, 20, 30]), rng.randint(1, 8)
        sizes = [rng.randint(1, room) for _ in range(n)]
        counts = [sizes.count(s) for s in range(room + 1)]
        fixed, left = packing.reduced(counts, room)
        rest = [s for s in range(room + 1) for _ in range(left[s])]
        assert sum(times for times, _ in fixed) + fewest(rest, room) == fewest(sizes, room)
        used = Counter()
        for times, held in [*fixed, *packing.best_fit(left, room)]:
            assert sum(s * c for s, c in held) <= room
            used.update({s: c * times for s, c in held})
        assert used == Counter(sizes)
        fixed_any += bool(fixed)
    assert fixed_any > 300


def best_fit_one_by_one(sizes, room):
    spaces = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in spaces if x >= s]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - s)
        else:
            spaces.append(room - s)
    return sorted(spaces)


def test_best_fit_is_best_fit():
    rng = random.Random(6)
    for _ in range(200):
        room = rng.choice([10, 50, 100])
        sizes = [rng.randint(1, room) for _ in range(rng.randint(1, 120))]
        counts = [sizes.count(s) for s in range(room + 1)]
        spaces = sorted(room - sum(s * c for s, c in held) for times, held in packing.best_fit(counts, room) for _ in range(times))
        assert spaces == best_fit_one_by_one(sizes, room)


def packed_as_promised(rows, texts, room=1024):
    """Checks every piece and every sequence; gives the number of sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, text in texts:
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 2]
        at, piece = 0, 0
        while at < len(ids):
            n = (len(ids) % room or room) if at == 0 else room
            expected[i, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, piece = at + n, piece + 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(held)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op11_best_fit_packing(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    n = packed_as_promised(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.op11_best_fit_packing(spark, SF).collect()))


def test_packing_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "no id"), (None, None), (4, "word " * 5000), (5, "x\n\n  y \n"), (6, "<|endoftext|> in a text"), *[(10 + k, "same words here") for k in range(400)]]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in texts], "doc_id long, text string, length int, sequence_id string")
    packed_as_promised(packing.pack(docs).collect(), texts)
    assert packing.pack(docs.limit(0)).collect() == []
    small = packing.pack(docs, room=16).collect()
    assert len(small) > len(texts)
    packed_as_promised(small, texts, 16)


# --- filter audit ----------------------------------------------------------------------------------------------------


def audited(docs, labels):
    """(part, order, step) -> counts, by applying each order to each document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = []
        for i, text, p in docs:
            if (p or "") == part:
                text = text or ""
                words = re.findall(r"[^\x20\x09-\x0D]+", text)
                fails = {
                    "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                    "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and text in least and least[text] < i,
                }
                own.append((i, {f for f in fails if fails[f]}))
        shares = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                all_f = [x for x in own if f in x[1]]
                shares[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(all_f) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return out


def audit_of(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, 1) for i, t, p in docs], "doc_id long, text string, lang string, fails int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.patterns(filter_audit.failures(filter_audit.measures(d)), known))
    return {tuple(r)[:3]: list(r)[3:] for r in found.collect()}


def test_audit_query(spark):
    check(filter_audit.op12_filter_audit(spark, SF), connect(SF), filter_audit.OP12_SQL)


def test_audit_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    docs = [
        (1, None, "en"), (2, "", "en"), (3, "ÄÖÜ ABC # x", None), (3, "ÄÖÜ ABC # x", None), (4, "ÄÖÜ ABC # x", ""), (None, "ÄÖÜ ABC # x", "de"), (None, None, "de"), (5, long, "de"), (6, long, "en"), (7, long + " " + long, "en"),
        (8, long.upper(), "en"), (9, "wort wort wort " * 200, "fr"), (10, "a" * 5000 + " " + "a" * 5000 + " " + "a" * 4999, "fr"), *[(20 + k, "copy & copy", "en") for k in range(60)],
    ]
    labels = [(5, 1, 0), (5, 0, 0), (6, None, 1), (7, 1, 1), (None, 1, 1), (21, 1, None), (99, 1, 1), (8, 0, 0)]
    assert audit_of(spark, docs, labels) == audited(docs, labels)
    assert audit_of(spark, docs[:0], labels) == {}
    assert audit_of(spark, docs[:3], labels[:0]) == audited(docs[:3], [])


def test_long_texts_are_read_in_pieces():
    text = (" ".join(f"Wort{k % 700}ü#" for k in range(5000)) + "x" * 3000 + "\t\n " + "y" * 10).encode()
    data = np.frombuffer(text, np.uint8)
    whole = filter_audit.counted(data, np.array([0, len(data)]))
    for most in (64, 1000, 4096):
        assert (filter_audit.counted(data, np.array([0, len(data)]), most) == whole).all()
    assert whole[1, 0] == len(set(text.split()))


def test_words_with_one_hash_stay_apart():
    words = [b"ab", b"cd", b"ab", b"abc", b"x" * 100, b"x" * 99 + b"y", b"x" * 100, b"12345678", b"12345679", b"123456789"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    owner = np.array([0, 0, 0, 0, 0, 0, 1, 0, 0, 0])
    new = filter_audit.distinct_spans(data, start, end, owner, np.zeros(len(words), np.uint64))
    assert new.tolist() == [True, True, False, True, True, True, True, True, True, True]


# --- centroids -------------------------------------------------------------------------------------------------------


def clustered(rows, dims, scale=256, k=40, rounds=5):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def test_clustering_query(spark):
    check(clusters.op13_incremental_kmeans(spark, SF), connect(SF), clusters.OP13_SQL)


def test_clustering_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(i, [0.5, -0.25, 1.0]) for i in range(100, 140)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 4.0]), (5, [9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0]), (206, [])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, dots string")
    key = lambda r: (r[0] is None, r)
    for k in (1, 7, 500):
        found, centroids = clusters.cluster(df, dims=3, k=k)
        plain, expected = clustered(rows, 3, k=k)
        assert centroids == expected
        assert sorted(map(tuple, found.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(plain, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    found, centroids = clusters.cluster(df.limit(0), dims=3)
    assert found.collect() == [] and centroids == []
    with pytest.raises(ValueError):
        clusters.cluster(spark.createDataFrame([(1, [1e9, 0.0, 0.0])], "vec_id long, embedding array<double>"), dims=3)


def test_dot_products_follow_the_centroids():
    rng = np.random.default_rng(4)
    v, old = rng.integers(-99, 99, (50, 6)), rng.integers(-99, 99, (4, 6))
    new = old.copy()
    new[1, 2], new[3] = 5, rng.integers(-99, 99, 6)
    dots = v @ old.T
    clusters.updated(dots, v, old, new)
    assert (dots == v @ new.T).all()
