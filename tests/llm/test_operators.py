"""Each operator against a plain version, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import time
import uuid
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import check, connect
from timberline.llm import components, decontaminate, exact_dedup, importance, mixing, queries, range_coder, repeats, simhash, token_output, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["id", "sig", "size", "fp", "root", "node", "_id", "_text", "_weight", "_hit_id", "_hit_sig", "_label_id", "_target", "_keep", "copies", "target", "kept", "start", "first", "label", "key", "class", "slice", "words", "window", "good", "shape"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def odd_rows(spark):
    long = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "one two"), (6, long), (7, long), (7, long), (8, "a  b"), (9, "a b"), (None, "a b"), (10, "x\u00a0y é ñ 漢字 😀"), (11, long[:70_000] + " tail")]
    df = spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", 0) for k, (i, t) in enumerate(rows)], SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(spark)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 1), (6, 1, None), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    check(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def roots(nodes, linked):
    above = {x: x for x in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


# --- 1 ---


def test_importance_keeps_what_is_good(spark, docs):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn, held = known.filter("doc_id % 5 < 3"), {r.doc_id: r.quality for r in known.filter("doc_id % 5 >= 3").collect()}
    kept = {r.doc_id for r in importance.sampled(own, learn).select("doc_id").collect()}
    good = [i in kept for i, q in held.items() if q == 1]
    bad = [i in kept for i, q in held.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_importance_weights_against_plain(spark, docs, texts):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    fit = known.filter("quality = 1 and xxhash64(doc_id, 17) % 2 = 0")
    target = {r.doc_id for r in fit.collect()}
    ratio, edge, scores = importance.resample(docs, known)

    def grams(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return importance.ngrams(data, np.array([0, len(data)]))[1]

    seen = np.zeros((2, importance.BUCKETS))
    for i, t in texts.items():
        for own in (0, 1) if i in target else (0,):
            np.add.at(seen[own], grams(t), 1)
    p = (seen[0] + 1) / (seen[0] + 1).sum()
    q = (seen[1] + 20 * len(p) * p) / (seen[1].sum() + 20 * len(p))
    plain = np.log(q) - np.log(p)
    assert np.allclose(ratio, plain)
    got = {r.id: r.log_weight for r in scores.collect()}
    assert all(abs(got[i] - plain[grams(t)].sum()) < 1e-6 for i, t in texts.items())
    known_good = {r.doc_id for r in known.filter("quality = 1 and xxhash64(doc_id, 17) % 2 <> 0").collect()}
    lowest = sorted((got[i] for i in known_good), reverse=True)[len(known_good) - int(0.002 * len(known_good)) - 1]
    k = sum(w >= lowest for w in got.values())
    hashed = {r.doc_id: (r.h % (1 << 64)) >> 11 for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    keys = {i: w - np.log(-np.log((hashed[i] + 0.5) / 2**53)) for i, w in got.items()}
    sample = {r.doc_id for r in importance.op1_importance_resampling(spark, SF).collect()}
    assert sample == set(sorted(keys, key=keys.get, reverse=True)[:k]) and abs(edge - min(keys[i] for i in sample)) < 1e-6


def test_ngrams_of_a_text():
    data = np.frombuffer(b"a a, b", np.uint8)
    doc, found = importance.ngrams(data, np.array([0, 4, 6]))
    assert sorted(Counter(doc.tolist()).items()) == [(0, 3 + 2 + 1), (1, 1)]


def test_kth_largest(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(500)] + [0.25] * 20
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 250, 519, 520):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, 521) is None


def test_importance_odd(spark, odd, none, labels):
    kept = importance.sampled(odd, labels)
    assert kept.columns == odd.columns and kept.count() > 0
    assert importance.sampled(odd, labels.filter("false")).count() == odd.count()
    assert importance.sampled(none, labels).count() == 0


# --- 2 ---


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 2 * len(source) == 2 * pages.count()
    for r in made:
        ((headers, block),) = warc.parse(warc.serialise(r.headers, bytes(r.block)))
        assert block == bytes(r.block) and headers == {k: v for k, v in r.headers.items()}
        assert r.block_digest == warc.digest(block) and r.refers_to in source
        if r.record_type == "conversion":
            assert r.payload_digest == source[r.refers_to].payload_digest and b"<" not in block.replace(b"<3", b"")
        else:
            assert f"source-payload-digest: {source[r.refers_to].payload_digest}".encode() in block and b"source-http-Content-Type" in block
    assert len({r.record_id for r in made}) == len(made)


def test_warc_text():
    page = "<!DOCTYPE html><html lang='de'><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><p>x  y<br>z</p><a href=/k>l</a></body></html>"
    assert warc.plain_text(page) == "A & B\nx y\nz\nl"


def test_warc_text_of_broken_and_long_pages():
    assert warc.plain_text("a<script>var x=1;") == "a" and warc.plain_text("a<!-- b") == "a" and warc.plain_text("a<b c") == "a"
    assert warc.plain_text("1 < 2 <3 <p>x</P >y</scripts>z<script-x>w</script-x>") == "1 < 2 <3\nx\nyzw"
    assert warc.read_page("<HTML Lang=EN><a title='x' href = \"u&amp;v\">k</a><a href='w'/><a name=z>") == ("k", "", "en", ["u&v", "w"])
    began = time.time()
    for part in ("<script x", "<script>", "<!--", "<a ", "<a href=", "<a href='", "<title>", "</", "<", "&amp", "x=", "<a " + "y" * 50, "<style>a</style>"):
        warc.read_page(part * 100_000)
        warc.read_page("<a " + part.replace("<", "") * 100_000 + ">")
    assert time.time() - began < 60


class PlainPage(HTMLParser):
    """Text of a page by Python's own parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.parts.append("\n" if tag in warc._LINES else " " if self.hidden else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.parts.append("\n" if tag in warc._LINES else "")

    def handle_comment(self, data):
        self.parts.append(" ")

    def handle_data(self, data):
        self.parts.append("" if self.hidden else data)

    def text(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.parts).split("\n")) if x)


def test_warc_query_against_plain(spark):
    """Every row of the query from hashlib, uuid and Python's HTML parser."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {(r.page_id, r.record_type): r for r in warc.op2_warc_derivatives(spark, SF).collect()}
    assert len(got) == 2 * len(pages)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for p in pages:
        html, url = (p.html or "").encode(), p.url or ""
        text = PlainPage(p.html or "").text().encode()
        r, m = got[p.page_id, "conversion"], got[p.page_id, "metadata"]
        source = f"<urn:uuid:{uuid.uuid5(warc.NAMESPACE, f'response|{p.page_id}|{url}|{sha1(html)}')}>"
        assert (r.refers_to, r.target_uri, r.payload_digest, r.block_digest, r.n_bytes, r.block_sha256) == (source, url, sha1(html), sha1(text), len(text), hashlib.sha256(text).hexdigest())
        assert (m.refers_to, m.target_uri) == (source, url) and m.record_id != r.record_id
        assert r.record_id == f"<urn:uuid:{uuid.uuid5(warc.NAMESPACE, f'conversion|{source}')}>"


def test_warc_odd(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/\r\nb", "<p>\u2028x"), (2, "http://a/\r\nb", "<p>\u2028x"), (None, "u", "")], "page_id long, url string, html string").withColumn("headers", F.lit(1))
    made = warc.derivatives(warc.responses(pages))
    assert made.count() == 8
    assert warc.derivatives(warc.responses(pages.filter("false"))).count() == 0
    warc.write_warc(made, f"file://{tmp_path}/out")
    import gzip

    found = [h for p in (tmp_path / "out").glob("*.warc.gz") for h, _ in warc.parse(gzip.open(p).read())]
    assert len(found) == 8


# --- 3 ---


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    for kind in (lambda n: np.minimum(rng.pareto(0.7, n) * 9, 65_534), lambda n: rng.integers(0, 65_535, n), lambda n: np.full(n, 7), lambda n: np.arange(n) % 5):
        blocks = [kind(n).astype(np.uint32) for n in (900, 900, 513, 40, 1)]
        prior = range_coder.Prior.of(np.concatenate(blocks))
        coded, read = range_coder.encode(blocks, prior), range_coder.Prior.unpack(prior.pack())
        assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks], read), strict=True))
        alone = range_coder.decode([coded[2]], [513], read)[0]  # blocks are read on their own
        assert (alone == blocks[2]).all()


def test_segments_are_checked():
    ids = np.arange(3000, dtype="<u2") % 300
    data = token_output.pack(ids)
    assert (token_output.unpack(data) == ids).all() and len(data) < 2 * len(ids)
    with pytest.raises(ValueError):
        token_output.unpack(data[:-400] + bytes([data[-400] ^ 1]) + data[-399:])


def test_encoder_by_word():
    encode = token_output.Encoder()
    assert encode.by_word
    texts = ["it's 12 o'clock    x", " lead", "tail ", "a\tb c", "😀 x ñ  ", "x \u3000y", "a \n b", "x  y", "", "plain words, and more.", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext |> c"]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_splits_at_marks_and_line_ends():
    encode = token_output.Encoder()
    texts = ["over. over, over! over\nover;\nover: over", "a.b ,c", "x\n\ny.\n.z", "don't.\n's", "\u00e9.\n\u00c4\n\u3000\n x", "\n", ".\n", "z\u0085\ny\n\u00a0.", "$9,9.\r\n1", "", "ab\n\u4e2d\nc?!\n?"]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids
    encode.forget()
    list(encode(texts[:1]))
    assert len(encode.known) == 8  # the word with and without a space, five marks and the line's end


def test_ranges_move_on_once_an_id():
    rng = np.random.default_rng(9)
    blocks = [rng.choice([3, 65_534], 3000, p=[0.999, 0.001]).astype(np.uint32), np.append(np.full(2999, 3), 65_534).astype(np.uint32)]
    prior = range_coder.Prior.of(np.arange(65_535))  # ids as rare as they get
    coded = range_coder.encode(blocks, prior)
    assert all(len(c) % 4 == 0 and len(c) < 4 * len(b) for c, b in zip(coded, blocks))
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded, [3000, 3000], prior), strict=True))


def token_rows(rows):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(token_output.tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, docs, texts):
    got = sorted(map(tuple, token_output.op3_token_files(spark, SF).collect()))
    assert got == token_rows(texts.items())


def test_token_files_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, token_output.tokens(odd).collect()), key=lambda r: r[1])
    assert got == token_rows(rows)
    assert token_output.tokens(none).count() == 0


# --- 4 ---


def test_mix_nears_targets(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(own, slice_rows=7).collect()
    by = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= 0.02 * v[0].target + max(r.size for r in v)
    assert sorted(map(tuple, mixing.mix(own, slice_rows=7).collect())) == sorted(map(tuple, rows))


def test_mix_odd(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {None, "s0", "s1"}
    out = mixing.emitted(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.emitted(none).count() == 0


# --- 5 ---


def plain_print(t, k=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius, shard", [(2, 4096), (14, 1), (14, 50)])
def test_simhash_components(docs, texts, radius, shard):
    prints = {i: plain_print(t) for i, t in texts.items()}
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= radius]
    expected = {i: (f"{prints[i]:016x}", r) for i, r in roots(ids, linked).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs, radius=radius, shard=shard).collect()} == expected


def test_bk_tree_finds_all():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    members = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(8)})
    tree = simhash.BKTree()
    for m in members:
        tree.add(m)
    for q in base:
        assert sorted(tree.within(q, 3)) == sorted(m for m in members if (m ^ q).bit_count() <= 3)


def test_components_of_chains(spark):
    rng = random.Random(2)
    linked = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    expected = {x: r for x, r in roots({x for e in linked for x in e}, linked).items()}
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert got == {x: r for x, r in expected.items() if x in got} and set(got) == {x for a, b in linked if a != b for x in (a, b)}


def test_simhash_odd(odd, none):
    got = simhash.near_groups(odd).collect()
    assert len(got) == odd.count() and {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    by = {r.doc_id: r.component_id for r in got}
    assert by[7] == 6 and by[8] == by[9] == by[None] == 8 and by[3] == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in sorted(x for x in by if x) if by[i] == i]
    assert simhash.near_groups(none).count() == 0


# --- 6 ---


def plain_removal(rows, length):
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)


def removal(df, length):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(df, length).collect())


def test_repeats(docs, texts):
    assert removal(docs, 200) == sorted(plain_removal([t.encode() for t in texts.values()], 200))


@pytest.mark.parametrize("length", [2, 7, 20])
def test_repeats_of_other_lengths(spark, length):
    rng = random.Random(length)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(120))) for _ in range(60)] + ["a" * 90, "aé" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert removal(df, length) == sorted(plain_removal([t.encode() for t in texts], length))


def test_repeats_odd(odd, none):
    texts = [(r.text or "").encode() for r in odd.collect()]
    assert removal(odd, 200) == sorted(plain_removal(texts, 200))
    assert repeats.without_repeats(none).count() == 0


def test_texts_of_which_nothing_is_known_are_not_shuffled(spark, tmp_path):
    rows = [(i if i % 50 else None, 7, f"text {i}") for i in range(2000)]
    spark.createDataFrame([r[:2] for r in rows if r[0] is None or r[0] % 100 == 1], "id long, sig long").write.parquet(str(tmp_path / "owners"))
    owners, others = repeats.divided(spark.createDataFrame(rows, "id long, sig long, text string").repartition(3), spark.read.parquet(str(tmp_path / "owners")))
    own, rest = owners.collect(), others.collect()
    assert sorted(r.text for r in own + rest) == sorted(r[2] for r in rows)
    assert {r.text for r in own} >= {r[2] for r in rows if r[0] is None or r[0] % 100 == 1} and len(own) <= 80
    text = next(line for line in others._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line)
    assert text and "hashpartitioning(id" not in others._jdf.queryExecution().executedPlan().toString()


def plain_starts(data, length):
    """Places of the strings (each ended by a byte 255) that begin ``length`` bytes that begin elsewhere too."""
    at = [i for i in range(len(data) - length + 1) if 255 not in data[i : i + length]]
    seen = Counter(data[i : i + length] for i in at)
    return [i for i in at if seen[data[i : i + length]] > 1]


def test_merge_of_shards():
    shards = [b"abcabc\xffxabc\xff", b"zzabcd\xff"]
    data, shard = np.frombuffer(b"".join(shards), np.uint8), np.repeat([0, 1], [len(s) for s in shards])
    assert np.flatnonzero(repeats.merge(data, shard, 3)).tolist() == [0, 3, 8, 14]


@pytest.mark.parametrize("length", [1, 3, 4, 5, 8, 13, 40])
def test_merge_against_plain(length):
    rng = random.Random(length)
    for n in (1, 2, 5):
        base = "".join(rng.choice("ab") for _ in range(300)).encode()
        shards = []
        for _ in range(n):
            cuts = [(a, a + rng.randrange(2 * length + 3)) for a in (rng.randrange(300) for _ in range(12))]
            shards.append(b"".join(base[a:b].replace(b"aba", rng.choice([b"aba", b"c"])) + b"\xff" for a, b in cuts))
        data, shard = np.frombuffer(b"".join(shards), np.uint8), np.repeat(np.arange(n), [len(s) for s in shards])
        assert np.flatnonzero(repeats.merge(data, shard, length)).tolist() == plain_starts(data.tobytes(), length)


def test_large_groups_are_dealt_out_by_string(docs, texts):
    expected = sorted(plain_removal([t.encode() for t in texts.values()], 50))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs, 50, most=2).collect()) == expected


# --- 7 ---


def test_rules_and_odd_urls(spark):
    urls = ["http://a.net/x", "http://NET/", "http://anet/x", "http://a.net", "https://x.example.net/en/1?q", "example.com/de/", None, "ftp://example.com/de/2#f", "http://www.example.com/DE/", "http://x.org/fr/", "a://b://c/d", "http://a.net?x=/y"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, good boolean").withColumns({c: F.lit(1) for c in ("host", "path", "shape", "rule", "template")})
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["net/", "net/", None, None, "example.net/en/", None, None, "example.com/de/", None, "org/fr/", None, None]
    assert [(got[i].host, got[i].path) for i in (1, 5, 6, 10, 11)] == [("net", "/"), ("", ""), ("", ""), ("b:", "//c/d"), ("a.net", "")]
    assert url_filter.judge(df.filter("false")).count() == 0


def test_bad_branches_are_rejected(spark):
    rows = [(i, f"http://h.test/{'spam' if i % 2 else 'news'}/{i}", None if i % 5 == 0 else i % 2 == 0) for i in range(400)]
    rows += [(1000 + i, f"http://h.test/news/sub{i}/{i}", True) for i in range(30)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, good boolean")).collect()
    assert all(r.verdict == ("block" if "/spam/" in r.path else "allow") for r in got)
    assert {r.template for r in got if r.page_id < 400} == {"/spam/*", "/news/*"}


def test_deep_branches_are_told_apart(spark):
    """Good and bad part at the sixth segment; small nodes aren't split further; page ids repeat, and urls may be long."""
    rows = [(i % 300, f"http://h.test/a/b/c/d/e/{'spam' if i % 2 else 'news'}/{i}", i % 2 == 0) for i in range(400)]
    rows += [(1000 + i, "http://few.test/x/y/z", None) for i in range(3)] + [(2000, "http://long.test/" + "s/" * 20_000 + "t", None), (2001, None, None), (2002, "http://h.test", None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, good boolean")).collect()
    assert len(got) == len(rows)
    assert {(r.template, r.verdict) for r in got if "/spam/" in r.path} == {("/*/*/*/*/*/spam/*", "block")}
    assert {(r.template, r.verdict) for r in got if "/news/" in r.path} == {("/*/*/*/*/*/news/*", "allow")}
    assert {r.template for r in got if r.host == "few.test"} == {"/**"} == {r.template for r in got if r.page_id == 2000}
    assert {(r.template, r.verdict) for r in got if r.page_id in (2001, 2002)} == {("", "allow")}


# --- 8 ---


def test_contamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "One!"), (2, None), (3, "..."), (4, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"), (5, "a B"), (5, "a B"), (6, "漢字"), (7, "never seen")], "item_id long, text string").withColumn("id", F.lit(1))
    got = {}
    for r in decontaminate.contamination(odd, items).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[7]) == 2 and got[7][0] == got[7][1]
    assert [(got[i][0].n_hit, got[i][0].items) for i in (1, 4, 5, 6, 8, 9, 10, None)] == [(0, []), (1, ["1"]), (1, ["1"]), (11, ["4"]), (2, ["5"]), (2, ["5"]), (1, ["6"]), (2, ["5"])]
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert decontaminate.contamination(none, items).count() == 0
    assert {r.contaminated for r in decontaminate.contamination(odd, items.filter("false")).collect()} == {False}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta x alpha y gamma"), (3, "alpha q q q q beta gamma"), (4, "gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    _, hits, _ = decontaminate.matches(docs, items, slack=2)
    assert {(r.id, r.kind) for r in hits.collect()} == {(1, "phrase"), (2, "near")}


@pytest.mark.parametrize("bits, joined", [(15, False), (15, True), (26, True)])
def test_matches_against_plain(spark, monkeypatch, bits, joined):
    """Phrases and near places of windows of four words; maps with many false marks; joins in place of broadcasts."""
    if joined:
        monkeypatch.setattr(decontaminate, "small", lambda df: df)
        monkeypatch.setattr(decontaminate, "fits", lambda df: False)
    rng, n, slack = random.Random(4), 4, 2
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [[rng.choice(vocabulary) for _ in range(rng.randrange(60))] for _ in range(40)]
    items = [docs[i][5 : 5 + rng.randrange(1, 9)] for i in range(0, 20, 2)] + [["w1"], ["w2", "w2", "w3"]]
    windows = {tuple(w[i : i + n]) for w in items for i in range(max(1, len(w) - n + 1)) if w}
    phrases = {(d, " ".join(w), i) for d, t in enumerate(docs) for w in windows for i in range(len(t)) if tuple(t[i : i + len(w)]) == w}
    near = {(d, " ".join(w)) for d, t in enumerate(docs) for w in windows for i in range(len(t)) if len(w) > 1 and set(w) <= set(t[i : i + len(w) + slack])}
    a = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    _, hits, owners = decontaminate.matches(a, b, size=n, slack=slack, bits=bits)
    texts = {hashlib.sha256(" ".join(w).encode()).hexdigest(): " ".join(w) for w in windows}
    rows = hits.collect()
    assert {(r.id, texts[r.window], r.start) for r in rows if r.kind == "phrase"} == phrases
    assert {(r.id, texts[r.window]) for r in rows} - {(d, w) for d, w, _ in phrases if " " not in w} == near | {(d, w) for d, w, _ in phrases if " " in w}
    assert {r.window for r in owners.collect()} == set(texts)


# --- 9 ---


def test_exact_odd(odd, none):
    got = {}
    for r in exact_dedup.exact_groups(odd).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(1, 2, True)] and got[2] == [(1, 2, False)] and got[3] == [(3, 1, True)]
    assert got[6] == [(6, 3, True)] and got[7] == [(6, 3, False)] * 2 and got[8] == [(8, 3, True)] and got[None] == [(8, 3, False)]
    assert got[11] == [(11, 1, True)]
    assert sorted(r.doc_id for r in exact_dedup.keep_first(odd).collect()) == [1, 3, 4, 5, 6, 8, 10, 11]
    assert exact_dedup.exact_groups(none).count() == 0


@pytest.mark.parametrize("bits", [15, 24])
def test_exact_without_broadcast(docs, texts, monkeypatch, bits):
    """Groups that are joined, not broadcast; with few bits nearly every text finds its bit marked."""
    monkeypatch.setattr(exact_dedup, "small", lambda df: df)
    monkeypatch.setattr(exact_dedup, "BITS", bits)
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()} == {i: first[re.sub(r"[\x20\x09-\x0D]+", " ", t)] for i, t in texts.items()}


def test_full_digests_are_of_what_is_left(spark, docs, texts):
    """Texts with a length or a beginning of their own aren't digested."""
    lengths = Counter(len(re.sub(r"[\x20\x09-\x0D]+", " ", t)) for t in texts.values())
    marked = exact_dedup._bits(spark.createDataFrame([(h + 1,) for h in (0, 7, 8, 40_000)], "h long"))
    asked = spark.range(1, 50_000).withColumnRenamed("id", "h").join(marked, F.bitmap_bucket_number("h") == F.col("bucket"), "left")
    assert [r.h for r in asked.filter(exact_dedup._marked("bits", "h")).orderBy("h").collect()] == [1, 8, 9, 40_001]
    assert 0 < sum(1 for n in lengths.values() if n > 1) < len(lengths)


# --- 10 ---


def test_toxicity_on_held_out(spark):
    own, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learn, held = known.filter("doc_id % 5 < 3"), {r.doc_id: r.toxic for r in known.filter("doc_id % 5 >= 3").collect()}
    got = {r.doc_id: r.is_toxic for r in toxicity.toxicity(own.join(known.select("doc_id"), "doc_id", "left_semi"), learn).collect()}
    hits = sum(got[i] and y for i, y in held.items())
    assert hits / sum(held.values()) > 0.85 and hits / sum(got[i] for i in held) > 0.85


def test_toxicity_query_against_plain(spark, docs, texts):
    """Probabilities of the fitted chain, text by text and word by word."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def bucket(word):
        data = np.frombuffer(word, np.uint8)
        return int(toxicity._ROLL.spans(toxicity._ROLL.sums(data), np.array([0]), np.array([len(data)]))[0] % np.uint64(toxicity.BUCKETS))

    for r in toxicity.op10_toxicity_chain(spark, SF).collect():
        own, before = {bucket(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", texts[r.doc_id].encode().lower())}, []
        for name, model, edge in zip(toxicity.CATEGORIES, chain.models, chain.edges, strict=True):
            z = sum(model.weights[b] for b in own) + sum(p * d for p, d in zip(before, model.dense, strict=True)) + model.bias
            before.append(1 / (1 + np.exp(-z)))
            assert abs(before[-1] - r[f"p_{name}"]) < 1e-9 and r[f"is_{name}"] == (r[f"p_{name}"] >= edge)


def test_conflicting_labels_count_the_same_each_time(spark):
    known = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for rows in (known, known.orderBy(F.col("quality").desc())):
        got = importance.bounded_labels(rows, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}).collect()
        assert sorted(map(tuple, got)) == [(1, True, True), (2, False, False)]


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    n = 600
    y1 = rng.random(n) < 0.4
    row, col = np.repeat(np.arange(n), 3), np.concatenate([np.where(y1, 1, 2)[:, None], rng.integers(10, 60, (n, 2))], axis=1).ravel()
    chain = toxicity.Chain(row, col, np.column_stack([y1, y1]), buckets=64)
    assert chain.models[1].dense.shape == (1,) and chain.models[1].dense[0] > 0
    assert ((chain.predict(row, col, n) >= chain.edges) == y1[:, None]).all()


def test_toxicity_odd(odd, none, labels):
    got = toxicity.toxicity(odd, labels)
    assert got.count() == odd.count()
    assert toxicity.toxicity(odd, labels.filter("false")).filter("is_toxic").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
