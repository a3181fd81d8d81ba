"""Packing of documents into sequences: small sets that dominate are fixed, the rest goes where it fits best."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import saved
from timberline.llm.token_output import END, encoder_of
from timberline.operators.order import numbered

#: Tokens in a sequence.
ROOM = 1024

#: How often a pattern is used, and what a sequence of it holds in order: (length, copies).
Pattern = tuple[int, list[tuple[int, int]]]


def pieces(docs: DataFrame, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's ids and ``end``, whole if they fit ``room``.

    A longer document is cut into pieces of ``room`` ids, the first of which holds what is over. Null and empty texts are one piece of the end id.
    Rows that repeat an id are documents of their own. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = encoder_of(path)
        for batch in batches:
            out = []
            for k, ids in enumerate(encoder(x.as_py() for x in batch.column(1))):
                raw = np.append(ids, np.uint16(end)).astype("<u4").tobytes()
                n = len(raw) // 4
                edges = [0, *range(n % room or room, n + 1, room)]
                out += [(k, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            at, piece, start, length, crc = np.array(out, np.int64).reshape(-1, 5).T
            columns = [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _most_besides(left: list[int], size: int, room: int) -> int:
    """How many pieces, the smallest ones, fit beside one of ``size``; 3 stands for more."""
    n, space = 0, room - size
    for s in range(1, space + 1):
        take = min(left[s] - (s == size), space // s)
        n, space = n + take, space - take * s
        if n > 2 or space < s:
            break
    return min(n, 3)


def _best_pair(left: list[int], size: int, most: int) -> tuple[int, int]:
    """The two lengths, larger first, of pieces besides one of ``size`` that fill ``most`` best; (0, 0) where no two fit."""
    held = [s for s in range(1, most) if left[s] - (s == size) > 0]
    best, i, j = (0, 0), 0, len(held) - 1
    while i <= j:
        small, large = held[i], held[j]
        if small + large > most:
            j -= 1
            continue
        if i < j or left[large] - (large == size) > 1:
            best = max(best, (large, small), key=lambda p: (sum(p), p[0]))
        i += 1
    return best


def _dominating(left: list[int], size: int, room: int) -> list[int] | None:
    """Lengths of a set with one piece of ``size`` that dominates every other set with it, or None where none of up to three pieces is known to.

    A set dominates another if the other's pieces can be parted into groups, each no longer than a piece of its own; then some best packing
    uses it. Martello and Toth's three cases: nothing fits beside the piece; one piece fits, or one fills the rest, and the longest is best; two
    fit, and the fullest pair is no longer than the longest single piece, or has that piece and leaves no pair between its own two.
    """
    space = room - size
    most = _most_besides(left, size, room)
    if not most:
        return [size]
    single = next(s for s in range(space, 0, -1) if left[s] - (s == size) > 0)
    if most == 1 or single == space:
        return [size, single]
    if most == 2:
        large, small = _best_pair(left, size, space)
        if single >= large + small:
            return [size, single]
        # single and large are the same where a pair has the longest piece; a pair of which both are longer than small must not fit
        if large == single:
            longer = [s for s in range(small + 1, space) for _ in range(min(2, left[s] - (s == size)))][:2]
            if len(longer) < 2 or sum(longer) > space:
                return [size, large, small]
    return None


def reduced(counts: list[int], room: int = ROOM) -> tuple[list[Pattern], list[int]]:
    """Patterns that a best packing may use, and the counts by length of what they leave.

    Lengths are tried from the largest down, again until no set dominates. A set is used as often as its pieces last at once: what dominates
    still does where there are fewer other pieces.
    """
    left, fixed, again = list(counts), [], True
    while again:
        again = False
        for size in range(room, 0, -1):
            while left[size] and (found := _dominating(left, size, room)):
                held = sorted({(s, found.count(s)) for s in found}, reverse=True)
                times = min(left[s] // n for s, n in held)
                fixed.append((times, held))
                for s, n in held:
                    left[s] -= n * times
                again = True
    return fixed, left


def best_fit(counts: list[int], room: int = ROOM) -> list[Pattern]:
    """Best fit of the pieces in descending length: each goes into the fullest sequence that has room for it, or a new one.

    Sequences with the same content are one pattern. A sequence that takes a piece is then the fullest one that may take the next, so
    those of a pattern are filled one after the other, all at once.
    """
    by_room: list[list[Pattern]] = [[] for _ in range(room + 1)]
    for size in range(room, 0, -1):
        n = counts[size]
        for space in range(size, room):
            kept: list[Pattern] = []
            for times, held in by_room[space]:
                each = space // size
                full = min(times, n // each)
                n -= full * each
                over, n = (n, 0) if full < times and n else (0, n)
                for count, copies in ((full, each), (1 if over else 0, over)):
                    if count:
                        by_room[space - copies * size].append((count, [*held, (size, copies)]))
                if times - full - bool(over):
                    kept.append((times - full - bool(over), held))
            by_room[space] = kept
            if not n:
                break
        each = room // size
        if n // each:
            by_room[room - each * size].append((n // each, [(size, each)]))
        if n % each:
            by_room[room - n % each * size].append((1, [(size, n % each)]))
    return [p for patterns in by_room for p in patterns]


def places(patterns: list[Pattern], room: int = ROOM) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: of length ``length``, those numbered from ``first`` on lie in the sequences from ``sequence`` on, ``copies`` in each, from ``offset`` on.

    Sorted by length and first, so that a piece's row is found by bisection. There are some rows for each pattern, and some patterns for each length.
    """
    used, sequence, rows = [0] * (room + 1), 0, []
    for times, held in patterns:
        offset = 0
        for size, copies in held:
            rows.append((size, used[size], sequence, copies, offset))
            used[size] += copies * times
            offset += size * copies
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "copies", "offset"), table.T, strict=True))


def placed(ranked: DataFrame, table: dict[str, np.ndarray], ahead: np.ndarray) -> DataFrame:
    """``ranked`` (id, piece, start, length, ids_crc32, rank: the place from 0 in order of length) with sequence_id and offset. ``ahead``: how many pieces are shorter, by length."""
    names = ("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the number of a piece over all lengths, where each row of the table begins
        begins = ahead[table["length"]] + table["first"]
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in (5, 3))
            row = np.searchsorted(begins, rank, side="right") - 1
            within, copies = rank - begins[row], table["copies"][row]
            sequence, offset = table["sequence"][row] + within // copies, table["offset"][row] + within % copies * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(sequence), pa.array(offset)], names=list(names))

    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.select(*names[:5], "rank").mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, room: int = ROOM, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per piece of :func:`pieces`: id, piece, start, length, ids_crc32, sequence_id, offset.

    Which lengths share a sequence depends on how many pieces have each length, and nothing else: ``room`` numbers that the driver gets, whatever the
    size of the table. :func:`reduced` fixes sets of up to three pieces that dominate all others with their first one, :func:`best_fit` packs the rest;
    both work on counts, so the patterns are those of all pieces, and are bounded by ``room`` too. Pieces are then numbered in order of length over all tasks
    (by ranges; a length that a third of all pieces have is several ranges), and a piece's number finds its sequence and place in the patterns by bisection.

    Texts are read once and never shuffled; pieces are a row each. An empty table gives an empty result; reruns agree, as pieces stand by length, id, place
    and checksum.
    """
    cut = saved(pieces(docs, room, id_col, **how), "pieces")
    counts = [0] * (room + 1)
    for length, n in cut.groupBy("length").count().collect():  # at most ``room`` rows
        counts[length] = n
    fixed, left = reduced(counts, room)
    table = places([*fixed, *best_fit(left, room)], room)
    ahead = np.concatenate([[0], np.cumsum(counts)])
    ranked = numbered(cut, "length", "id", "start", "ids_crc32", after=-1)
    return placed(ranked, table, ahead).withColumnRenamed("id", id_col)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
