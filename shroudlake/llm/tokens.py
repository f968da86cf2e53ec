"""Token ids in binary shards, compressed by a Re-Pair grammar."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_path

MAGIC = b"RPG1"
#: Ids in a shard at least (a document is never cut, so a longer one makes a longer shard).
SHARD_IDS = 1 << 18
#: Most pairs a round, and the count below which a pair isn't replaced: a rule takes 8 bytes, an occurrence saves 2.
PAIRS, LEAST = 2048, 4
#: Pieces whose ids a worker remembers; beyond this it starts anew.
MEMO = 1_000_000


def _slot(pairs: np.ndarray) -> np.ndarray:
    """A place of 16 bits for each pair."""
    with np.errstate(over="ignore"):
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(16) if pairs.dtype == np.uint32 else (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _choose(kinds: np.ndarray, counts: np.ndarray, shift: int, room: int) -> np.ndarray:
    """The most frequent pairs, sorted, of which none can overlap another one and no two have one slot."""
    top = np.argsort(-counts, kind="stable")[: PAIRS + PAIRS // 4]
    some, mask, most, chosen = kinds[top].tolist(), (1 << shift) - 1, min(PAIRS, room), []
    side = bytearray(max(max(k >> shift, k & mask) for k in (int(kinds.max()), int((kinds & kinds.dtype.type(mask)).max()))) + 1)
    for k in some:  # a symbol is the first one of pairs (1), or the second one (2)
        a, b = k >> shift, k & mask
        if side[a] > 1 or side[b] & 1 or a == b and side[a]:
            continue
        if len(chosen) == most:
            break
        side[a], side[b] = 1, 2
        if a == b:
            side[a] = 3
        chosen.append(k)
    keys = np.array(sorted(chosen), kinds.dtype)
    last = np.zeros(1 << 16, np.int16)
    last[_slot(keys)] = np.arange(len(keys))
    return keys[last[_slot(keys)] == np.arange(len(keys))]  # of two with one slot the other waits for the next round


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, lengths): the grammar of ids, all below base.

    Each round counts the adjacent pairs and replaces the most frequent ones by new symbols, base, base + 1, ...;
    pairs of one round share no symbol in a way that lets their occurrences overlap. Rounds end when no pair occurs
    LEAST times, or when 16 bits have no symbol left. Rule k is a row (left, right) of
    symbols below base + k; lengths[k] is the number of ids that it expands to.

    A pair that is too rare once stays so, since new neighbours always have a new symbol among them: later rounds count
    only where a pair was frequent or a new symbol is.
    """
    seq, rules, size = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    live = np.arange(max(0, len(seq) - 1))
    while len(live):
        wide = base + len(rules) > 1 << 16
        kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
        left, right = (seq[:-1], seq[1:]) if len(live) == len(seq) - 1 else (seq[live], seq[live + 1])
        pairs = (left.astype(kind) << kind(shift)) | right
        order = np.sort(pairs)
        often = order[LEAST - 1 :][order[LEAST - 1 :] == order[: 1 - LEAST]] if len(order) >= LEAST else order[:0]
        room = (1 << 16) - base - len(rules) if base < 1 << 16 else PAIRS  # 16-bit symbols as long as they last
        if not len(often) or room <= 0:
            break
        starts = np.flatnonzero(np.concatenate(([True], often[1:] != often[:-1])))
        kinds, counts = often[starts], np.diff(np.append(starts, len(often))) + LEAST - 1
        keys = _choose(kinds, counts, shift, room)
        slots = _slot(pairs)
        table = np.zeros(1 << 16, np.int16)
        table[_slot(keys)] = np.arange(len(keys))
        rank = table[slots]
        hit = np.flatnonzero(keys[rank] == pairs)
        at, rank = live[hit], rank[hit]
        touch = np.concatenate(([False], np.diff(at) == 1))
        if touch.any():  # a run of one symbol: every second occurrence
            first = np.maximum.accumulate(np.where(~touch, np.arange(len(at)), 0))
            even = (np.arange(len(at)) - first) % 2 == 0
            at, rank = at[even], rank[even]
        frequent = np.zeros(1 << 16, bool)
        frequent[_slot(kinds)] = True
        flags = np.zeros(len(seq), bool)
        flags[live] = frequent[slots]
        flags[at] = True
        flags[np.maximum(at - 1, 0)] = True
        seq[at] = np.uint32(base + len(rules)) + rank.astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        live = np.flatnonzero(flags[keep][:-1])
        new = np.stack((keys >> kind(shift), keys & kind((1 << shift) - 1)), 1).astype(np.int64)
        length = np.where(new < base, 1, size[np.maximum(new - base, 0)] if len(size) else 1)
        size = np.concatenate((size, length.sum(axis=1)))
        rules = np.concatenate((rules, new.astype(np.uint32)))
    return seq, rules, size


def unfold(rules: np.ndarray, size: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths): where each symbol's ids are in one array, terminals first."""
    starts = np.concatenate((np.arange(base), base + np.concatenate(([0], np.cumsum(size)))[:-1])).astype(np.int64)
    lengths = np.concatenate((np.ones(base, np.int64), size))
    ids = np.concatenate((np.arange(base, dtype=np.uint32), np.zeros(int(size.sum()), np.uint32)))
    low = 0
    while low < len(rules):  # the rules of a round use earlier ones alone, so they are filled together
        part = rules[low:]
        high = low + int(np.argmax(np.concatenate(((part >= base + low).any(axis=1), [True]))))
        for side, shift in ((0, np.zeros(high - low, np.int64)), (1, lengths[rules[low:high, 0]])):
            symbol = rules[low:high, side]
            n = lengths[symbol]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(starts[base + low : base + high] + shift, n) + inner] = ids[np.repeat(starts[symbol], n) + inner]
        low = high
    return ids, starts, lengths


def expand(seq: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a part of a compressed sequence."""
    ids, starts, lengths = table
    n = lengths[seq]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[seq] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def pack(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    """A shard: MAGIC, base, width and counts; then rules, their expansion lengths, the sequence and document ends."""
    seq, rules, size = compress(ids, base)
    wide = base + len(rules) > 1 << 16
    kind = "<u4" if wide else "<u2"
    head = np.array([base, 4 if wide else 2, len(rules), len(seq), len(ends)], "<u4").tobytes()
    return MAGIC + head + rules.astype(kind).tobytes() + size.astype("<u4").tobytes() + seq.astype(kind).tobytes() + ends.astype("<u8").tobytes()


class Shard:
    """A shard opened for reading; documents are decoded one at a time or all together."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.base, width, n_rules, n_seq, n_docs = np.frombuffer(blob, "<u4", 5, 4).tolist()
        kind, at = ("<u4" if width == 4 else "<u2"), 24
        self.rules = np.frombuffer(blob, kind, 2 * n_rules, at).reshape(-1, 2).astype(np.uint32)
        at += 2 * n_rules * width
        self.size = np.frombuffer(blob, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.seq = np.frombuffer(blob, kind, n_seq, at)
        self.ends = np.frombuffer(blob, "<u8", n_docs, at + n_seq * width).astype(np.int64)
        self.table = unfold(self.rules, self.size, self.base)
        self._at: np.ndarray | None = None

    def all(self) -> np.ndarray:
        return expand(self.seq, self.table)

    def doc(self, k: int) -> np.ndarray:
        """The ids of the k-th document: only the symbols that cover it are expanded."""
        if self._at is None:
            self._at = np.concatenate(([0], np.cumsum(self.table[2][self.seq])))
        a, b = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        if a == b:
            return np.zeros(0, np.uint32)
        i, j = int(np.searchsorted(self._at, a, "right")) - 1, int(np.searchsorted(self._at, b, "left"))
        return expand(self.seq[i:j], self.table)[a - int(self._at[i]) : b - int(self._at[i])]


#: Piece -> ids, by tokenizer file; it lasts as long as the worker, over tasks.
_MEMOS: dict[str, "Memo"] = {}

#: How `word_bpe` files make and cut texts into pieces: fixed values of their format.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case texts of ASCII and Latin letters up to U+017F, which no normal form changes.
_LATIN = re.compile("[a-zß-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\x0b\x0c\ra-zß-öø-ſ0-9]+")
_NOT_LATIN = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-įı-ſ]|<\\|")
#: The printable character that stands for each byte in byte-level vocabularies: fixed by their format.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


_ALLOWED = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def _latin(text: str) -> bool:
    """Whether a text is of ASCII and Latin letters alone and can hold no added token."""
    if text.isascii():
        return "<|" not in text
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _NOT_LATIN.search(text)
    return not raw.translate(None, _ALLOWED) and b"<|" not in raw


class Memo(dict):
    """The ids, as bytes, of pieces of texts; unknown ones are encoded by the tokenizers library.

    Texts of ASCII and Latin letters are cut into the pieces of the tokenizer itself, which its model then encodes.
    In other texts a piece is what stands between ASCII white space, and takes the whole way through the tokenizer;
    that is exact where no token crosses white space, as `word_bpe` files have it: they drop white space. With any
    other file a text is encoded as a whole, by the library.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        rules = json.loads(self.tokenizer.to_str())
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_piece = (
            (rules["normalizer"] or {}).get("normalizers") == _NORMAL
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": _PIECES}
            and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"]
            and rules["model"]["type"] == "BPE"
            and all("<|" in t["content"] and not any(c.isspace() for c in t["content"]) for t in rules["added_tokens"])
        )

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str | bytes) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if isinstance(piece, str):
            text = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
            value = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        else:
            value = self._whole(piece.decode("utf-8", "replace"))
        self[piece] = value
        return value

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not self.by_piece:
            return self._whole(text)
        if _latin(text):
            return b"".join(map(self.__getitem__, _LATIN.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


def memo_of(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]


def write_ids(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, order: list[str] | None = None) -> str:
    """Writes the ids of every text, in ascending order of the key (or by the columns of order), as a table of shards at path.

    Columns: part and shard (in order), n_ids, keys (array), blob (see pack). The texts are range-partitioned by the
    order, a partition is a part, and its shards have a grammar each, so that what a task holds is bounded: a task holds
    one shard at a time. Null keys come first; a null text is empty and has the end id alone. Rows with equal keys keep
    places of their own, by text. Keys may have any type that Arrow has. An empty table writes no shard.
    """
    order = order or [key]
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)])
    by = [F.col(f"_by{i}").asc_nulls_first() for i in range(len(order))]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by, "_text").select("_key", "_text")
    names = ["part", "shard", "n_ids", "keys", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, end = memo_of(tokenizer), np.array([end_id], "<u4").tobytes()
        base, part, shard = max(memo.base, end_id + 1), TaskContext.get().partitionId(), 0
        keys, parts, ends, n, kind = [], [], [], 0, None

        def full() -> pa.RecordBatch:
            blob = pack(np.frombuffer(b"".join(parts), "<u4"), np.array(ends), base)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([blob], pa.binary())], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memo.encode(t.as_py()) + end
                keys.append(k)
                parts.append(ids)
                n += len(ids) // 4
                ends.append(n)
                if n >= SHARD_IDS:
                    yield full()
                    keys, parts, ends, n, shard = [], [], [], 0, shard + 1
        if keys:
            yield full()

    rows.mapInArrow(run, f"part int, shard int, n_ids long, keys array<{df.schema[key].dataType.simpleString()}>, blob binary").write.parquet(path)
    return path


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A row for each document of the files at path: the key, part, shard, start, n_tokens and ids_crc32.

    start is the number of ids of all documents before it; ids_crc32 is over the decoded ids as little-endian unsigned
    32-bit integers. Shards get their starts from sums by part, then over parts; blobs aren't shuffled.
    """
    table = spark.read.parquet(path)
    meta = table.select("part", "shard", "n_ids")
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_part_start"))
    shards = meta.select("part", "shard", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0)).alias("_shard_start"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("_part_start") + F.col("_shard_start")).alias("_start"))
    kind = table.schema["keys"].dataType.elementType
    names = ["_key", "part", "shard", "_at", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, keys, blob in zip(*(batch.column(c) for c in range(4)), strict=True):
                opened = Shard(blob.as_py())
                raw, ends = opened.all().astype("<u4").tobytes(), opened.ends
                at = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([keys.values, pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(at, pa.int64()), pa.array(ends - at, pa.int64()), pa.array(crc, pa.int64())], names=names)

    docs = table.select("part", "shard", "keys", "blob").mapInArrow(run, f"_key {kind.simpleString()}, part int, shard int, _at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select(F.col("_key").alias(key), "part", "shard", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", path: str | None = None, order: list[str] | None = None) -> DataFrame:
    """write_ids into path (else a new folder below the shared one), then read_ids from it. The files stay."""
    spark = df.sparkSession
    return read_ids(spark, write_ids(df, path or scratch_path(spark, "token-ids"), tokenizer, key, text, order=order), key)
