"""Token ids as compressed binary shards, and their reader."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import partitions, saved, small
from timberline.llm.range_coder import NONE, Prior, decode, encode
from timberline.llm.textbytes import Rolling, same_spans

#: Ids in a block, and blocks in a segment (a row of the file), at most.
BLOCK, LANES = 2048, 2048
END = 2
MAGIC = b"TLTOKEN1"
#: Words of which an encoder remembers the ids, before it forgets all, and characters of text that it works on at once.
REMEMBERED, AT_ONCE = 600_000, 2 << 20
#: The same where ids are coded beside: a smaller one takes no longer, and some 100 MB less.
AT_ONCE_CODING = 1 << 19
#: New words that are encoded in one call's text.
TOGETHER = 128

_ROLL = Rolling(0xA0761D6478BD642F)
_ALONE = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _LETTER, _MARK, _BEFORE_LINE, _AFTER_LINE = 1, 2, 4, 8, 16
#: What a byte may be to its neighbours. Beyond ASCII, characters that begin with C3 to DF are never white space.
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x20] = _SPACE
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KINDS[list(b".,;:!?")] = _MARK
_KINDS[0x21:0x7F] |= _BEFORE_LINE | _AFTER_LINE
_KINDS[0xC3:0xE0] |= _AFTER_LINE


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts. Of byte-level BPE without a prefix space, each different word is encoded once while it is remembered.

    Its pattern never joins a space to what is before it, unless white space or the end follows. A text in which each space is followed by
    something else is thus encoded word by word, with the space before the word; any other text, and one that holds the name of an added token, is encoded in one piece.
    Nor does it join a mark of ``.,;:!?`` to an ASCII letter before it, or a line's end to what is beside it unless that is white space too; so words end there as well, and
    most of them are met again. New words are encoded end to end, and their ids told apart by the tokens that begin with a space.

    Texts are worked on some MB at a time: their words are told apart by hashes and compared with the first of their hash, byte by byte; each different one is
    looked up once, and all texts' ids are gathered from those of the words.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or tokenizer_path()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not parts.get("normalizer")
        size = self.tokenizer.get_vocab_size()
        if size > NONE:
            raise ValueError("ids of more than 16 bits aren't supported")
        self.added = [x["content"] for x in parts.get("added_tokens") or []]
        self.spaces = re.compile(r" (?:\s|\Z)")
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """Gives the memory of all words back."""
        #: word -> its number; one without a space before it is known by a space
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, "<u2"), np.zeros(1 << 16, np.int64)  # all words' ids end to end; ends[k + 1] is where those of number k end

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(self.known), int(self.ends[len(self.known)])
        while len(self.ends) < n + len(words) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = at + np.cumsum(sizes)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of different words; new ones are learned."""
        if len(self.known) > REMEMBERED:
            self.forget()
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(numbers < 0)
        if not len(unknown):
            return numbers
        new = [words[i] for i in unknown.tolist()]
        after, alone = ([w for w in new if w.startswith(b" ") is first] for first in (False, True))
        if after:
            runs = [(b" " + b" ".join(after[i : i + TOGETHER])).decode() for i in range(0, len(after), TOGETHER)]
            ids = np.concatenate([np.array(x.ids, "<u2") for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
            at = np.flatnonzero(self.spaced[ids])
            self._add(after, ids, np.diff(at, append=len(ids)))
        if alone:
            coded = [np.array(x.ids, "<u2") for x in self.tokenizer.encode_batch_fast([w[1:].decode() for w in alone], add_special_tokens=False)]
            self._add(alone, np.concatenate(coded), np.array([len(x) for x in coded]))
        numbers[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return numbers

    def _by_words(self, texts: list[str]) -> list[np.ndarray] | None:
        """The ids of texts that may be encoded word by word; None if two different words have one hash."""
        raws = [x.encode() for x in texts]
        raw = b" ".join([b"", *raws, b""])
        data = np.frombuffer(raw + bytes(8), np.uint8)
        kind = _KINDS[data[: len(raw)]]
        space, letter, mark, left, right = ((kind & x) > 0 for x in (_SPACE, _LETTER, _MARK, _BEFORE_LINE, _AFTER_LINE))
        line = data[: len(raw)] == 0x0A  # line ends that are words of their own
        line[1:-1] &= left[:-2] & right[2:]
        begins = line.copy()
        begins[1:] |= line[:-1] | letter[:-1] & mark[1:] | space[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        end -= space[end - 1]
        first_of = np.searchsorted(start, np.cumsum([1, *[len(x) + 1 for x in raws[:-1]]]))  # each text's first word
        alone = ~space[start - 1]  # without a space before
        alone[first_of] = True
        _, first, same = np.unique(_ROLL.spans(_ROLL.sums(data), start, end) ^ (alone * _ALONE), return_index=True, return_inverse=True)
        sizes = end - start
        if not ((sizes == sizes[first][same]).all() and (alone == alone[first][same]).all() and same_spans(data, raw, start, start[first][same], sizes).all()):
            return None
        words = [b" " + raw[i:j] if k else raw[i:j] for i, j, k in zip(start[first].tolist(), end[first].tolist(), alone[first].tolist(), strict=True)]
        number = self._numbers(words)[same]
        begin, stop = self.ends[number], self.ends[number + 1]
        sizes = stop - begin
        total = np.cumsum(sizes)
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - (total - sizes), sizes)]
        return np.split(ids, np.append(0, total)[first_of[1:]])

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [self.by_word and not self.spaces.search(x) and not any(a in x for a in self.added) for x in texts]
        some = [x for x, p in zip(texts, plain, strict=True) if p]
        found = iter((some and self._by_words(some)) or map(self._ids, some))
        for text, p in zip(texts, plain, strict=True):
            yield next(found) if p else self._ids(text)

    def __call__(self, texts: Iterable[str | None], at_once: int = AT_ONCE) -> Iterator[np.ndarray]:
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= at_once:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str | None = None) -> Encoder:
    """The process's encoder for a vocabulary file; a Python worker's later tasks find the words that its earlier ones learned."""
    path = path or tokenizer_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: magic, sizes, the table of shares of its ids; for each block the number of its ids, CRC-32 of them, and bytes; then the blocks."""
    size = max(512, min(block, len(ids) // 512))
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    prior = Prior.of(ids)
    shares, coded = prior.pack(), encode(blocks, prior)
    table = [struct.pack("<III", len(b), zlib.crc32(b.astype("<u4").tobytes()), len(c)) for b, c in zip(blocks, coded, strict=True)]
    return b"".join([MAGIC, struct.pack("<II", len(blocks), len(shares)), shares, *table, *coded])


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment. A block whose ids don't have its checksum is an error."""
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    n, head = struct.unpack_from("<II", data, 8)
    prior, at = Prior.unpack(data[16 : 16 + head]), 16 + head
    table = [struct.unpack_from("<III", data, at + 12 * i) for i in range(n)]
    at, coded = at + 12 * n, []
    for _, _, length in table:
        coded.append(data[at : at + length])
        at += length
    blocks = decode(coded, [x[0] for x in table], prior)
    for i, (b, (_, crc, _)) in enumerate(zip(blocks, table, strict=True)):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of block {i}")
    return np.concatenate([np.zeros(0, np.uint32), *blocks])


def written(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, block: int = BLOCK, lanes: int = LANES, remember: bool = False) -> DataFrame:
    """The files' rows: (shard, segment, n_ids, doc_ids, n_tokens, data). Documents are in ascending order of id over shards and segments.

    A segment holds whole documents, about ``block`` x ``lanes`` ids of them at most unless one document has more, and is read for itself.
    Null and empty texts have the end id alone. Rows that repeat an id follow each other in the order of their texts' hashes; null ids come first. A very long text is one
    segment, however many ids it has. Other columns are not read. An empty table gives no rows. With ``remember``, a Python worker keeps the ids of the words that it
    met, up to ``REMEMBERED``, for its later tasks: less work, but some 100 MB more.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    by = ("id", "_text")  # rows without an id, or of one id, are dealt out by their texts
    ordered = rows.withColumn("_text", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), *by).sortWithinPartitions(*by).drop("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, shard = encoder_of(path), TaskContext.get().partitionId()
        held, owners, total, segment = [], [], 0, 0

        def out():
            own = pa.array([owners], pa.list_(id_type))
            sizes = pa.array([[len(x) for x in held]], pa.list_(pa.int64()))
            data = pa.array([pack(np.concatenate(held), block)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([segment]), pa.array([total]), own, sizes, data], names=["shard", "segment", "n_ids", "doc_ids", "n_tokens", "data"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = (x.as_py() for x in batch.column(1))
            for owner, ids in zip(batch.column(0).to_pylist(), encoder(texts, AT_ONCE_CODING), strict=True):
                if held and total + len(ids) + 1 > block * lanes:
                    yield out()
                    held, owners, total, segment = [], [], 0, segment + 1
                held.append(np.append(ids, np.uint16(end)))
                owners.append(owner)
                total += len(ids) + 1
        if held:
            yield out()
        if not remember:
            encoder.forget()  # coding and later stages need the memory more

    return ordered.mapInArrow(run, f"shard long, segment long, n_ids long, doc_ids array<{kind.simpleString()}>, n_tokens array<long>, data binary")


def read_back(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens and ids_crc32.

    The starts of segments come from the files' counts: sums over shards, then within a shard.
    """
    sizes = files.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("of_shard"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.withColumn("within", within).join(ahead, "shard").select("shard", "segment", (F.col("of_shard") + F.col("within")).alias("begin"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column(5)[i].as_py()).astype("<u4")
                sizes = np.array(batch.column(4)[i].as_py(), np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                owners = batch.column(3)[i].values
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([owners, pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())), pa.array(at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], names=["id", "shard", "segment", "at", "n_tokens", "ids_crc32"])

    found = files.select("shard", "segment", "n_ids", "doc_ids", "n_tokens", "data").mapInArrow(run, f"id {kind}, shard long, segment long, at long, n_tokens long, ids_crc32 long")
    begins = small(saved(begins, "begins"))
    return found.join(begins, ["shard", "segment"]).select(F.col("id").alias(id_col), (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens(docs: DataFrame, **how) -> DataFrame:
    """``docs`` written to token files in the shared folder, and what the files hold of each document."""
    return read_back(saved(written(docs, **how), "tokens"), how.get("id_col", "doc_id"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), remember=True)
