"""Suffix-array deduplication: repeated strings of a given length, by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import exact_dedup
from timberline.llm.common import partitions, removed, saved, small, text_or_empty
from timberline.llm.textbytes import Rolling, chunks

#: Bytes that a string must have to count as repeated.
LENGTH = 200
#: Bytes of contexts that one merge takes in, about, while it holds whole groups.
MERGED = 1 << 20
#: Different contexts of an anchor that one merge takes in at most; the strings of larger groups are dealt out by their own hashes.
CONTEXTS = 2048

_ANCHOR, _A, _B = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F), Rolling(0x165667B19E3779F9)
_FEW = 1 << 20
#: Ends each string; no byte of UTF-8.
_END = 255


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor hash, context hash) of the runs of strings of ``length`` bytes that share an anchor.

    A string's anchor is the third of its bytes, at any place, that hashes least (the first of equals). Equal strings have equal anchors
    at equal places. A context is all bytes of a run's strings; it is told from others by both hashes, 128 bits.
    """
    half = max(1, length // 3)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sums = _ANCHOR.sums(data)
    at = np.arange(len(data) - half + 1)
    keys = _ANCHOR.spans(sums, at, at + half)
    width = length - half + 1
    chosen = np.zeros(len(data) - length + 1, np.int64)
    for k in range(0, len(chosen), _FEW - 2 * width):  # places fit into the low 20 bits
        part = keys[k : k + _FEW - width]
        tagged = (part & ~np.uint64(_FEW - 1)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_least(tagged, width)[: _FEW - 2 * width]
        chosen[k : k + len(least)] = k + (least & np.uint64(_FEW - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], len(chosen)) - 1
    a = _A.sums(data)
    where = (chosen[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # the anchor's place in the context
    return first, last - first + 1, keys[chosen[first]].view(np.int64), (_A.spans(a, first, last + length) ^ where).view(np.int64)


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, context, id, sig, first, starts) of every run of every document; see :func:`anchors`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            found = [anchors(data[a:b], length) for a, b in zip(at[:-1], at[1:])]
            row = np.repeat(np.arange(batch.num_rows), [len(x[0]) for x in found])
            first, starts, anchor, context = (np.concatenate([x[i] for x in found]) for i in range(4))
            owners = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), *owners, pa.array(first), pa.array(starts)], names=["anchor", "context", "id", "sig", "first", "starts"])

    rows = docs.select("id", "sig", "text").filter(F.octet_length("text") >= length)
    return rows.mapInArrow(run, f"anchor long, context long, id {rows.schema['id'].dataType.simpleString()}, sig long, first long, starts long")


def _blocks(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _words(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` bytes (4 at most) from each place on as a number, and whether a string ends within them."""
    padded = np.concatenate([data, np.full(size, _END, np.uint8)])
    word, ended = np.zeros(len(data), np.uint32), np.zeros(len(data), bool)
    for k in range(size):
        part = padded[k : k + len(data)]
        word = (word << np.uint32(8)) | part
        ended |= part == _END
    return word, ended


def shard_orders(data: np.ndarray, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix arrays of the shards, one after another: places in the order of (shard, first ``length`` bytes), and which share all of those with another of the shard.

    By prefix doubling, each round only for what isn't told apart yet. A suffix that ends before ``length`` bytes is like no other.
    """
    size = min(4, length)
    word, ended = _words(data, size)
    key = (shard.astype(np.uint64) << np.uint64(40)) | word
    key[ended] = (shard[ended].astype(np.uint64) << np.uint64(40)) | np.uint64(1 << 39) | np.flatnonzero(ended).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = _blocks(key[order])
    rank = np.empty(len(data), np.int64)  # the slot in which a block of equals begins
    slots = np.arange(len(data))
    while True:
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if size >= length or not len(slots):
            break
        step = min(size, length - size)
        live = order[slots]
        key = (rank[live].astype(np.uint64) << np.uint64(32)) | rank[live + step].astype(np.uint64)
        dealt = np.argsort(key, kind="stable")
        order[slots], key = live[dealt], key[dealt]
        new, size = _blocks(key), size + step
    again = np.zeros(len(data), bool)
    again[slots] = True
    return order, again


def merge(data: np.ndarray, shard: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places of the strings in ``data`` begin ``length`` bytes that begin elsewhere too: flags.

    ``data`` has the strings of one shard after those of another, each string ended by a byte 255; ``shard`` is a number for each byte, not falling.
    Each shard's suffixes are sorted for themselves; that gives its Burrows-Wheeler transform (the bytes before the suffixes, in their
    order) and what repeats inside it. The transforms are then merged by refining an interleave of them, which leaves each shard's own order as it is
    and compares no suffixes: the shards first stand one after another, as one block. In each round all that a block holds looks at its next four
    symbols of the transform, and the suffixes that begin with these are dealt into the order of the symbols, stable; so after k rounds the interleave is in order
    by the first 4k bytes, and a block is an interval with that common prefix. A block that one shard alone fills is in order already and leaves;
    suffixes with fewer than ``length`` bytes before them can't get there and aren't followed. What is left at ``length`` bytes are the
    intervals that several shards share.
    """
    if len(data) < 2:
        return np.zeros(len(data), bool)
    places, again = shard_orders(data, shard, length)
    owner, row = shard[places], np.empty(len(data), np.int64)
    row[places] = np.arange(len(data))
    transforms = {}
    for size in {1, 4} if length % 4 else {4}:
        word, ended = _words(data, size)
        before = places - size
        ahead = np.maximum(before, 0)  # of suffixes at a string's begin the symbol would be from another string
        transforms[size] = word[ahead], np.where((before >= 0) & ~ended[ahead], row[ahead], -1).astype(np.int32)
    slot = np.arange(len(data))
    begin = np.maximum.accumulate(np.concatenate([[0], np.where(data[:-1] == _END, slot[1:], 0)]))  # of the string that a place is in
    order = np.flatnonzero((slot - begin >= length)[places]).astype(np.int32)  # the others have too little before them
    block = np.zeros(len(order), np.int32)
    for size in [1] * (length % 4) + [4] * (length // 4):
        symbols, previous = transforms[size]
        target = previous.take(order)
        kept = np.flatnonzero(target >= 0)
        symbol = symbols.take(order.take(kept))
        dealt = np.argsort(symbol.astype(np.uint16), kind="stable")  # by halves: numbers of 16 bits are dealt, not compared
        if size > 1:
            dealt = dealt.take(np.argsort((symbol >> np.uint32(16)).astype(np.uint16).take(dealt), kind="stable"))
        symbol, kept = symbol.take(dealt), kept.take(dealt)
        order, own = target.take(kept), block.take(kept)
        if not len(order):
            break
        begins = np.flatnonzero(_blocks(symbol, own))
        sizes = np.diff(np.append(begins, len(order)))
        shared = owner.take(order.take(begins)) != owner.take(order.take(begins + sizes - 1))  # within a block shards stand in their order
        stays = np.repeat(shared, sizes)
        order, block = order[stays], np.repeat(np.arange(int(shared.sum()), dtype=np.int32), sizes[shared])
    out = np.zeros(len(data), bool)
    out[places[again]] = True
    out[places[order]] = True
    return out


def repeated_starts(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, sig, start, end) of stretches of strings that occur in two different contexts of an anchor.

    Contexts of an anchor meet in one task, where the transforms of the shards that they come from are merged, whole groups at a time.
    """

    def flush(group: list[tuple], out: list[tuple]) -> None:
        group.sort(key=lambda r: r[5])
        texts = [r[4] for r in group]
        data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        found = merge(data, np.repeat(np.array([r[5] for r in group], np.int32), [len(t) + 1 for t in texts]), length)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))  # a string's end is never flagged
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        which = np.searchsorted(at, edges[::2], side="right") - 1
        for i, a, b in zip(which.tolist(), (edges[::2] - at[which]).tolist(), (edges[1::2] - at[which]).tolist(), strict=True):
            _, owner, sig, first, _, _ = group[i]
            out.append((owner, sig, first + a, first + b - 1 + length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, last, out, kind = [], 0, None, [], None
        names = ["anchor", "id", "sig", "first", "text", "shard"]
        for batch in batches:
            kind = batch.schema.field("id").type
            for row in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True):
                if size > MERGED and row[0] != last:
                    flush(group, out)
                    group, size = [], 0
                    yield _stretches(out, kind)
                    out = []
                group.append(row)
                size += len(row[4])
                last = row[0]
        if group:
            flush(group, out)
            yield _stretches(out, kind)

    n = partitions(contexts.sparkSession)
    kind = contexts.schema["id"].dataType.simpleString()
    ordered = contexts.repartition(n, "anchor").sortWithinPartitions("anchor").select("anchor", "id", "sig", "first", "text", "shard")
    return ordered.mapInArrow(run, f"id {kind}, sig long, start long, end long")


def repeated_strings(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same of groups with too many different contexts for one task: only equal strings meet, by 128 bits of hash, summed before the shuffle."""
    kind = contexts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(4).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                starts = [len(t) - length + 1 for t in texts]
                row = np.repeat(np.arange(len(texts)), starts)
                within = np.arange(len(row)) - np.repeat(np.cumsum([0, *starts[:-1]]), starts)
                begin = at[row] + within
                hashes = [pa.array(r.spans(r.sums(data), begin, begin + length).view(np.int64)) for r in (_A, _B)]
                rows = pa.array(row)
                start = pa.array(within + np.array(part.column(2).to_pylist(), np.int64)[row])
                yield pa.RecordBatch.from_arrays([*hashes, part.column(0).take(rows), part.column(1).take(rows), start, part.column(3).take(rows)], names=["a", "b", "id", "sig", "start", "n"])

    strings = saved(contexts.select("id", "sig", "first", "n", "text").mapInArrow(run, f"a long, b long, id {kind}, sig long, start long, n long"), "strings")
    twice = saved(strings.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "b"), "twice")
    return strings.join(small(twice), ["a", "b"], "left_semi").select("id", "sig", "start", (F.col("start") + length).alias("end"))


def _stretches(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, *[pa.int64()] * 3))], names=["id", "sig", "start", "end"])


def divided(docs: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose (id, sig) may be in the written table ``owners``, all that are among them; and those that surely aren't.

    Owners mark bits in a map of 2^24 bits, which is broadcast: so of texts that nothing is known of, few are shuffled.
    """

    def h(df: DataFrame) -> DataFrame:
        return df.withColumn("h", F.pmod(F.xxhash64("id", "sig"), F.lit(1 << exact_dedup.BITS)) + 1)

    marks = F.broadcast(saved(exact_dedup.marks(h(owners.select("id", "sig"))), "marks"))
    asked = h(docs).join(marks, F.bitmap_bucket_number("h") == F.col("bucket"), "left").withColumn("owns", F.coalesce(exact_dedup.marked("bits", "h"), F.lit(False)))
    return tuple(asked.filter(own).select(docs.columns) for own in (F.col("owns"), ~F.col("owns")))


def cut_contexts(docs: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, id, sig, first, n, hot, text, shard): the bytes of the ``wanted`` runs (id, sig, first, starts, anchor, n, hot; a written table) of the documents."""
    lists = wanted.groupBy("id", "sig").agg(F.collect_list(F.struct("first", "starts", "anchor", "n", "hot")).alias("runs")).withColumnsRenamed({"id": "w_id", "sig": "w_sig"})
    owners, _ = divided(docs, wanted)
    joined = owners.join(lists, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("sig") == F.col("w_sig"))).select("id", "sig", "text", "runs")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for whole in batches:
            for batch, data, at in chunks(iter([whole])):
                lists = batch.column(3)
                runs = lists.flatten()
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                first, starts = (runs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                raw, begin = data.tobytes(), at[row] + first
                texts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + starts - 1 + length).tolist())]
                rows = pa.array(row)
                columns = [runs.field(2), batch.column(0).take(rows), batch.column(1).take(rows), runs.field(0), runs.field(3), runs.field(4), pa.array(texts, pa.binary()), pa.array(np.full(len(row), shard))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "sig", "first", "n", "hot", "text", "shard"])

    return joined.mapInArrow(run, f"anchor long, id {kind}, sig long, first long, n long, hot boolean, text binary, shard long")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most: int = CONTEXTS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, spans (start, end), and ``kept``, the bytes that are left.

    A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else, in the same or another document.

    1. Every document is cut into runs of strings that share an anchor; equal strings share anchor and place in it, so an anchor that
       occurs once has no repeated string. Only hashes leave here.
    2. Equal contexts of an anchor go on as one, with their number. What such a context holds is repeated as a whole.
    3. Of anchors with several contexts, each context is cut out of a document. All contexts of an anchor meet in one task, where the
       Burrows-Wheeler transforms of the shards that they come from are merged (:func:`merge`), and the repeated intervals read off.
    4. Anchors with over ``most`` contexts (the edge of a passage that very many documents share) would be too much for one task: of those, each
       string is dealt out by its own hash and counted (:func:`repeated_strings`).

    Texts are shuffled only of documents that have contexts to cut, or spans (:func:`divided`); all others are read in place.

    Null and empty texts, and texts shorter than ``length``, stay whole. Rows that repeat an id and its text are one document's rows: they
    share spans, and are repeats of each other. Texts are taken as UTF-8. Other columns are not read. An empty table gives an empty result.
    """
    ids = docs.groupBy(F.col(id_col).alias("id")).count().filter("count > 1 or id is null")
    sig = F.lit(0).cast("long") if ids.isEmpty() else F.xxhash64(text_or_empty(text_col))  # tells rows that share an id apart
    rows = docs.select(F.col(id_col).alias("id"), sig.alias("sig"), text_or_empty(text_col).alias("text"))

    runs = saved(occurrences(rows, length), "runs")
    often = saved(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "often")  # written, so that the join can be split at an anchor with very many runs
    every, runs = runs, saved(runs.join(small(often), "anchor", "left_semi"), "candidates")
    removed(every)
    same = runs.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "sig", "first", "starts")).alias("one"))
    same = saved(same.select("anchor", "context", "n", "one.*"), "contexts")
    several = saved(same.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("anchor", (F.col("contexts") > most).alias("hot")), "several")
    wanted = saved(same.drop("context").join(small(several), "anchor"), "wanted")
    cut = saved(cut_contexts(rows, wanted, length), "cut")
    merged = repeated_starts(cut.filter("not hot"), length).unionByName(repeated_strings(cut.filter("hot"), length))
    twice = small(saved(same.filter("n > 1").select("anchor", "context"), "twice"))
    whole = runs.join(twice, ["anchor", "context"], "left_semi").select("id", "sig", F.col("first").alias("start"), (F.col("first") + F.col("starts") - 1 + length).alias("end"))
    spans = saved(whole.unionByName(merged).groupBy("id", "sig").agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")
    owners, others = divided(rows, spans)
    spans = spans.withColumnsRenamed({"id": "s_id", "sig": "s_sig"})
    joined = owners.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("sig") == F.col("s_sig")), "left").select("id", "text", "found")
    joined = joined.unionByName(others.select("id", "text", F.lit(None).cast(spans.schema["found"].dataType).alias("found")))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            lists, out = batch.column(2), []
            spans = lists.flatten()
            start, end = (spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            depth = np.bincount(at[row] + start, minlength=len(data) + 1) - np.bincount(at[row] + end, minlength=len(data) + 1)
            gone_all = np.cumsum(depth[:-1]) > 0
            for i, owner in enumerate(batch.column(0).to_pylist()):
                own, gone = data[at[i] : at[i + 1]], gone_all[at[i] : at[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                out.append((owner, len(own), int(gone.sum()), len(edges) // 2, [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()], own[~gone].tobytes()))
            types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            names = ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    done = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
    return done.withColumnRenamed("id", id_col)


def op6_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
