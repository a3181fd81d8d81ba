"""SimHash near-deduplication: fingerprints, and links between them by BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import fresh, partitions, saved, small, text_or_empty
from timberline.llm.components import connected

#: Fingerprints in one tree at most; fuller buckets are cut finer, then into several trees.
SHARD = 4096
#: Bands of MinHash, and hashes in each.
BANDS, BAND = 12, 4
#: Texts of a group that are decided at once, and that all others of the group are then held against; and how many others a task takes.
LEADERS, PART = 256, 2048
#: Parts of a group whose first texts are sought apart.
PARTS = 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64. No words: zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - shingle] + 1).tolist()]
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class BKTree:
    """Numbers in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (x, {})
                return
            node = child

    def within(self, x: int, radius: int) -> list[int]:
        """All members at most ``radius`` away: a child can hold one only if its key is that close to the parent's distance."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            y, children = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                found.append(y)
            if children:
                if len(children) <= 2 * radius:
                    todo += [c for k, c in children.items() if -radius <= k - d <= radius]
                else:
                    todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found


def spanning(rows: Iterable[tuple[int, bool]], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect the same numbers as all pairs within the radius do, one less than there are numbers at most.

    ``rows`` has (number, is a query): pairs are sought among members, and between queries and the members before them.
    """
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    tree = BKTree()
    for x, query in rows:
        for y in tree.within(x, radius):
            a, b = top(x), top(y)
            if a != b:
                above[max(a, b)] = min(a, b)
                yield x, y
        if not query:
            tree.add(x)


def band_cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``parts`` bands that share ``bits`` bits out."""
    at = [round(i * bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _value(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """(fp) distinct -> (a, b): links that leave the same components as all pairs at most ``radius`` bits apart.

    Two such fingerprints agree in at least one of radius + 1 bands, so each goes to the bucket of each of its
    bands. A bucket with over ``shard`` members is cut again by the bits outside its band, in the same way; one
    that is still too full is dealt to several trees by a hash, and each of its members is sought in
    its own tree and in all the later ones. No bucket is capped, and a task's memory holds one tree at a time.
    """
    bands = band_cuts(64, radius + 1)
    rows = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _value(F.col("fp"), *b).alias("value")) for i, b in enumerate(bands)])).alias("_b")).select("fp", "_b.*")
    sizes = saved(rows.groupBy("band", "value").count().filter(F.col("count") > 1), "bands")
    rows = rows.join(sizes, ["band", "value"]).select("fp", "band", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue"), (F.col("count") > shard).alias("full"))
    parts = [rows.filter(~F.col("full")).drop("full").withColumn("trees", F.lit(1).cast("long"))]

    rest = []  # the bits outside each band, as one number of 64 - width bits
    for low, width in bands:
        below, above = F.col("fp").bitwiseAND(F.lit((1 << low) - 1)), F.shiftrightunsigned("fp", low + width) if low + width < 64 else F.lit(0).cast("long")
        rest.append((F.shiftleft(above, low).bitwiseOR(below), 64 - width))
    finer = rows.filter("full").drop("full", "sub", "subvalue").withColumn("_b", F.explode(F.array(*[
        F.struct(F.lit(j).alias("sub"), F.coalesce(*[F.when(F.col("band") == i, _value(r, *band_cuts(n, radius + 1)[j])) for i, (r, n) in enumerate(rest)]).alias("subvalue"))
        for j in range(radius + 1)])))
    finer = finer.select("fp", "band", "value", "_b.*")
    again = finer.groupBy("band", "value", "sub", "subvalue").count().filter(F.col("count") > 1)
    parts.append(finer.join(again, ["band", "value", "sub", "subvalue"]).withColumn("trees", F.ceil(F.col("count") / shard).cast("long")).select(*parts[0].columns))

    dealt = parts[0].unionByName(parts[1]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")))
    dealt = dealt.withColumn("tree", F.explode(F.sequence(F.col("own"), F.col("trees") - 1))).withColumn("query", F.col("tree") > F.col("own"))
    key = ["band", "value", "sub", "subvalue", "tree"]
    n = partitions(prints.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sorted_rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in (*key, "query", "fp")], strict=True)

        out: list[tuple[int, int]] = []
        for _, group in groupby(sorted_rows(), key=lambda r: r[:5]):
            out.extend(spanning(((r[6] & 0xFFFFFFFFFFFFFFFF, r[5]) for r in group), radius))
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return dealt.repartition(n, *key).sortWithinPartitions(*key, "query", "fp").select(*key, "query", "fp").mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): the smallest id that links of at most ``radius`` bits reach.

    Equal fingerprints are one node, so copies cost one row per task before the shuffle, not pairs. Null and
    empty texts have fingerprint zero and are linked like others. Rows that repeat an id are
    rows of their own, in components as their texts say. A null id has a component but names one only where no
    other id is in it. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = connected(links(nodes.select("fp"), radius, shard))
    # of the fingerprints that have links; written tables on both sides, so that joins are split at a giant component or a fingerprint with very many rows
    linked = saved(nodes.join(small(saved(roots, "roots")), nodes.fp == F.col("node")).select("fp", "first", "root"), "linked")
    least = small(saved(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least"))
    named = linked.join(least, "root").select(F.col("fp").alias("_f"), "component_id")
    named = saved(nodes.join(small(saved(named, "named")), nodes.fp == F.col("_f"), "left").select("fp", F.when(F.col("_f").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")), "components")
    return prints.join(small(named), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of all runs of ``size`` words; a shorter text is one run. No words: none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of at least ``least``; empty sets are equal."""
    few, many = sorted((len(a), len(b)))
    if few < least * many:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (few + many - both)


_ODD = np.random.default_rng(17).integers(1, 1 << 63, (BANDS * BAND, 2), dtype=np.uint64) | np.uint64(1)


def _bands(shingles: np.ndarray) -> list[int]:
    """One number for each band of MinHash: sets of similarity s agree in one with probability s ** BAND."""
    if not len(shingles):
        return [0] * BANDS
    mixed = shingles ^ (shingles >> np.uint64(29))
    least = np.fromiter((((mixed * a + b) >> np.uint64(20)).min() for a, b in _ODD), np.uint64, len(_ODD)).reshape(BANDS, BAND)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least)]


def _marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, size: int) -> DataFrame:
    """(id, sig, fp, bands) of every row; ``sig`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bands = [], []
            for t in batch.column(2):
                prints.append(fingerprint(t.as_py(), shingle))
                bands.append(_bands(_shingles(t.as_py(), size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["id", "sig", "fp", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("sig"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sig long, fp long, bands array<long>")


def _sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(sig, words): the shingles of each of the ``members`` (sig, first), whose text is read from its first id's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_shingles(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())], names=["sig", "words"])

    own = members.select(F.col("sig").alias("_m"), "first")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("sig"), F.col(text_col).alias("text"))
    rows = rows.join(small(own), (F.col("sig") == F.col("_m")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    return rows.select("sig", "text").mapInArrow(run, "sig long, words binary").groupBy("sig").agg(F.first("words").alias("words"))


def _judged(open_: DataFrame, least: float, leaders: int) -> DataFrame:
    """(root, place key, sig, words) -> (sig, gone) of the leaders of each root, and of those rows that are like a leader that stays.

    A root's leaders are its first ``leaders`` rows. They meet each part of the root's other rows, so a task holds
    one root's leaders and one row at a time, whatever the root's size.
    """
    by, first = ("nameless", "first", "sig"), open_.select("root", "nameless", "first", "sig", F.pmod(F.xxhash64("sig"), F.lit(PARTS)).alias("part"))
    for key in (("root", "part"), ("root",)):  # the first rows of each root are among the first of its parts, so no task sees a whole root
        first = first.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter(F.col("k") <= leaders)
    first = saved(first.select("sig", "k"), "leaders")
    parts = open_.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    rows = open_.join(first, "sig", "left").join(parts, "root")
    own = F.when(F.col("k").isNull(), F.array(F.pmod(F.xxhash64("sig"), F.col("parts")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = rows.withColumn("part", F.explode(own)).select("root", "part", F.coalesce("k", F.lit(leaders + 1)).cast("long").alias("k"), "sig", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stay = None, []
        for batch in batches:
            out = []
            for root, part, k, sig, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (root, part):
                    at, stay = (root, part), []
                mine = np.frombuffer(words, np.uint64)
                gone = any(similar(mine, other, least) for other in stay)
                if k <= leaders:
                    if not gone:
                        stay.append(mine)
                    if part == 0:
                        out.append((sig, gone))
                elif gone:
                    out.append((sig, True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.bool_())], names=["sig", "gone"])

    n = partitions(open_.sparkSession)
    return dealt.repartition(n, "root", "part").sortWithinPartitions("root", "part", "k").mapInArrow(run, "sig long, gone boolean")


def _regrouped(open_: DataFrame, least: float) -> DataFrame:
    """(root, nameless, first, sig, words) -> the same with finer roots, without the rows that can't be like any other one that is left.

    Two sets with a similarity of ``least`` share so many elements that the rarest 1 - ``least`` of one and of the other, and one more each, have one in common
    (rare within the root, in one order for both). So rows are linked through those alone: pages of one template, which share what all of it has and
    nothing else, are left without a link. A link for each such element, to the least hash that has it, no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) if x else np.zeros(1, np.int64) for x in batch.column(2).to_pylist()]  # no words: one element of their own
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["root", "sig", "n", "elements"])

    rows = open_.select("root", "sig", "words").mapInArrow(run, "root long, sig long, n long, elements array<long>").select("root", "sig", "n", F.explode("elements").alias("element"))
    rows = saved(rows, "elements")
    shared = saved(rows.groupBy("root", "element").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    held = rows.join(small(shared), ["root", "element"])
    own = Window.partitionBy("sig")
    head = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - (F.col("n") - F.count("*").over(own))  # the rows' own elements come first, and link nothing
    rare = held.withColumns({"k": F.row_number().over(own.orderBy("df", "element")), "head": head}).filter("k <= head").select("root", "element", "sig")
    rare = saved(rare, "rare")
    least_of = rare.groupBy("root", "element").agg(F.min("sig").alias("b"), F.max("sig").alias("top")).filter("b < top").drop("top")
    edges = rare.join(small(saved(least_of, "least")), ["root", "element"]).filter("sig <> b").select(F.col("sig").alias("a"), "b").distinct()
    roots = connected(edges).select(F.col("node").alias("sig"), F.col("root").alias("finer"))
    return open_.join(small(saved(roots, "roots")), "sig").select(F.col("finer").alias("root"), "nameless", "first", "sig", "words")


def unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, size: int = 5, least: float = 0.8, leaders: int = LEADERS) -> tuple[DataFrame, DataFrame]:
    """(marks, gone): the marks (id, sig) of all rows, and the hashes (sig) of texts that are like one that stays and comes before.

    Texts come in the order of their least ids (none at the end), then of their hashes. A text goes if a candidate before it stays and the sets of their runs of
    ``size`` words have a Jaccard similarity of ``least`` or more, which is computed from the sets. Candidates are texts
    that links of fingerprints or shared MinHash bands connect, so a pair of similarity 0.8 is missed by the bands alone
    about once in 550 times.

    The first ``leaders`` texts of each group are decided, and with them all that are like one of those. What is left is grouped anew by the rare elements of
    its sets (:func:`_regrouped`) before the next ``leaders`` are: so rounds don't grow with a template's pages, but with
    the texts that share their rarest runs and are unlike each other all the same.
    """
    marks = saved(_marks(docs, id_col, text_col, shingle, size), "marks")
    nodes = saved(marks.groupBy("sig").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    keys = nodes.select("fp", F.posexplode("bands").alias("band", "value")).distinct()
    heads = saved(keys.groupBy("band", "value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").drop("top"), "bands")
    shared = keys.join(small(heads), ["band", "value"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    roots = connected(links(nodes.select("fp").distinct(), radius).unionByName(shared))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("sig", "first", F.coalesce("root", "fp").alias("root"))
    several = saved(rooted.groupBy("root").count().filter("count > 1").select("root"), "several")
    members = saved(rooted.join(small(several), "root", "left_semi").withColumn("nameless", F.col("first").isNull()), "members")
    open_ = saved(members.join(_sets(docs, members, id_col, text_col, size), "sig").select("root", "nameless", "first", "sig", "words"), "sets")
    gone = marks.select("sig").filter("false")
    rounds = 0
    while not open_.isEmpty():
        judged = saved(_judged(open_, least, leaders), "judged")
        gone = gone.unionByName(judged.filter("gone").select("sig"))
        open_ = saved(open_.join(small(judged.select("sig")), "sig", "left_anti"), "left")
        rounds += 1
        if rounds & (rounds - 1) == 0 and not open_.isEmpty():  # again after 1, 2, 4, ... rounds, as elements become rarer
            open_ = saved(_regrouped(open_, least), "open")
    return marks.select("id", "sig"), saved(gone, "gone")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those whose text is like one that stays and comes before, see :func:`unlike`.

    Of rows with the same text one stays, that of the smallest id (one without an id only if no other has one). Rows that
    repeat an id are judged by their own texts. All columns are kept.
    """
    own, sig = fresh(docs, "_one_id"), fresh(docs, "_one_sig")
    marks, gone = unlike(docs, id_col, text_col, shingle, radius, size, least)
    # sorts and joins of few rows: texts with copies, and texts that go
    counts = marks.groupBy("sig").agg(F.min("id").alias("first"), F.count("*").alias("n")).join(small(gone).withColumn("gone", F.lit(True)), "sig", "left").filter("gone or n > 1")
    judged = saved(marks.join(small(saved(counts, "counts")), "sig").select("id", "sig", F.col("gone").isNotNull().alias("gone"), F.col("id").eqNullSafe(F.col("first")).alias("is_first")), "rows")
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty(text_col)) == F.col(sig))
    named = lambda x: small(saved(x.select(F.col("id").alias(own), F.col("sig").alias(sig)).distinct(), "names"))
    kept = docs.join(named(judged.filter("gone or not is_first")), same, "left_anti")
    again = saved(judged.filter("not gone and is_first").groupBy("id", "sig").count().filter("count > 1"), "again")
    if again.isEmpty():
        return kept
    again, text = named(again), fresh(docs, "_text_sig")
    once = kept.join(again, same, "left_semi").withColumn(text, F.xxhash64(text_or_empty(text_col))).dropDuplicates([id_col, text]).drop(text)
    return kept.join(again, same, "left_anti").unionByName(once)


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
