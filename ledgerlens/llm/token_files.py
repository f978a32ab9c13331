"""Token-id output: shards of concatenated ids with Elias-Fano document boundaries.

A shard is one binary value, the image of a file:

    8 bytes   magic
    header    documents, documents with a null id, ids, smallest document id, bytes an id
    EF        end offset of each document in the id array
    EF        document ids less the smallest, null ids left out (they come first)
    ids       little-endian, 2 bytes each where the vocabulary allows, else 4

Spark's Parquet writer holds the images, one row each with its place (part, seq): its commit
protocol makes retried and lost tasks harmless on any store.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Words, int64, steps, table
from .elias_fano import EliasFano

MAGIC = b"EFIDS\x00\x00\x01"
_HEAD = struct.Struct("<QQQqB")
#: A shard closes at so many ids; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: Words whose ids a worker remembers; beyond, it starts anew.
CACHE_WORDS = 300_000
#: Bytes of text that are encoded at a time: the more, the fewer distinct words.
ENCODE_BYTES = 6 << 20


#: Fixed value: the one way of splitting texts that pieces() knows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_into_pieces(path: str) -> bool:
    """Whether the tokenizer of that file lower-cases texts and cuts them as pieces() does, white space dropped."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = lambda x: (x or {}).get("normalizers") or (x or {}).get("pretokenizers") or [x or {}]
    lower = any(n.get("type") == "Lowercase" for n in parts(spec.get("normalizer")))
    cuts = [n for n in parts(spec.get("pre_tokenizer")) if n.get("type") == "Split"]
    return lower and [(n["pattern"].get("Regex"), n["behavior"], n["invert"]) for n in cuts] == [(SPLIT, "Removed", True)]


class Encoder:
    """Ids of whole texts. Where the tokenizer drops white space and never joins over it, a text's ids
    are its words' ids one after the other: each distinct word is encoded once, in runs of words
    with the one-token word BAR between them, remembered, and ids are gathered from there. With any other
    tokenizer whole texts are encoded."""

    BAR, RUN = "|", 2000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.by_pieces = splits_into_pieces(path)
        self.bar = self.tokenizer.encode(self.BAR, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.lens = np.zeros(0, np.uint16 if self.width == 2 else np.uint32), np.zeros(0, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        own = np.array([self.BAR in w for w in words], bool) if len(self.bar) == 1 else np.ones(len(words), bool)
        rest = [w for w, o in zip(words, own.tolist(), strict=True) if not o]
        parts, lens = [], np.zeros(len(words), np.int64)
        for k in range(0, len(rest), self.RUN):
            text = f" {self.BAR} ".join(rest[k : k + self.RUN] + [""])
            parts.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        bars = np.flatnonzero(ids == self.bar[0])
        lens[~own] = np.diff(bars, prepend=-1) - 1
        ids = np.delete(ids, bars)
        if own.any():  # words with the bar in them: alone, and put in between
            alone = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([w for w, o in zip(words, own.tolist(), strict=True) if o], add_special_tokens=False)]
            at = (np.cumsum(lens) - lens)[own]
            n = np.fromiter(map(len, alone), np.int64, len(alone))
            ids = np.insert(ids, np.repeat(at, n), np.concatenate(alone))
            lens[own] = n
        return ids, lens

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of distinct words, through what is remembered."""
        names = words.to_pylist()
        if len(self.place) > CACHE_WORDS:
            self.forget()
        fresh = [w for w in names if w not in self.place]
        if fresh:
            ids, lens = self.encode(fresh)
            self.place.update(zip(fresh, range(len(self.lens), len(self.lens) + len(fresh)), strict=True))
            self.ids, self.lens = np.concatenate([self.ids, ids.astype(self.ids.dtype)]), np.concatenate([self.lens, lens])
        slot = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        lens, at = self.lens[slot], (np.cumsum(self.lens) - self.lens)[slot]
        take = np.arange(lens.sum()) + np.repeat(at - np.cumsum(lens) + lens, lens)
        return self.ids[take].astype(np.uint32), lens

    def batch(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end`` after each text, and the number of ids of each text."""
        if not self.by_pieces:
            got = [np.array([*e.ids, end], np.uint32) for e in self.tokenizer.encode_batch_fast(col.to_pylist(), add_special_tokens=False)]
            return np.concatenate(got or [np.zeros(0, np.uint32)]), np.fromiter(map(len, got), np.int64, len(got))
        coded, bounds = pieces(col)
        flat, lens = self.words(coded.dictionary)
        at = np.cumsum(lens) - lens
        index = np.asarray(coded.indices)
        n = lens[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(ends[-1])
        take += np.repeat(at[index] - ends[:-1], n)
        return np.insert(flat[take], ends[bounds[1:]], end), np.diff(ends[bounds]) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder of that file, which later tasks use again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_B = np.arange(256)
_LETTER = ((_B | 32) >= 0x61) & ((_B | 32) <= 0x7A) & (_B < 0x80)
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_MARK = (_B > 0x20) & (_B < 0x7F) & ~_LETTER & ~_DIGIT & (_B != 0x27)
#: 1 ASCII letter, 2 ASCII mark but the apostrophe, 3 ASCII digit, 0 all else.
_KIND = (_LETTER * 1 + _MARK * 2 + _DIGIT * 3).astype(np.uint8)


def pieces(col: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' words, cut further where the tokenizer always cuts (between ASCII letters, marks and
    digits, and at every digit) and in lower case, as a dictionary array; and where each text begins.
    Where a text may name a special token, words stay as they are."""
    w = Words(col, SPACE, True)
    if b"<|" in w.data.tobytes():
        w = Words(col, SPACE, False)
        starts, ends = w.starts, w.ends
    else:
        kind = _KIND[w.data]
        cut = np.zeros(len(kind) + 1, bool)
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (a != 0) & (b != 0) & ((a != b) | (a == 3)) & w._word[:-1] & w._word[1:]
        cut[w.starts] = False  # also where one text ends and the next begins at once
        inner = np.flatnonzero(cut)
        starts, ends = np.sort(np.concatenate([w.starts, inner])), np.sort(np.concatenate([w.ends, inner]))
    lens = (ends - starts).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    joined = pa.StringArray.from_buffers(len(lens), pa.py_buffer(offsets), pa.py_buffer(w.data[w._word]))
    return joined.dictionary_encode(), np.searchsorted(starts, w.off)


def image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    low = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum(counts), len(ids) + 1)
    names = EliasFano.encode(known.astype(np.uint64) - np.int64(low).astype(np.uint64), int(known[-1]) - low + 1 if len(known) else 1)
    head = _HEAD.pack(len(doc_ids), len(doc_ids) - len(known), len(ids), low, width)
    return MAGIC + head + ends.to_bytes() + names.to_bytes() + ids.astype(f"<u{width}").tobytes()


class Shard:
    """A shard read back. ``span(k)`` finds the k-th document by select alone; ``ids`` is a view."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.docs, self.nulls, n, self.low, width = _HEAD.unpack_from(raw, 8)
        self.ends, at = EliasFano.from_bytes(raw, 8 + _HEAD.size)
        self.names, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw, f"<u{width}", n, at)

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def doc_ids(self) -> list[int | None]:
        known = (self.names.decode() + np.int64(self.low).astype(np.uint64)).view(np.int64)
        return [None] * self.nulls + known.tolist()


def write_shards(docs: DataFrame, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards and returns their table: part, seq, n_docs, n_ids, image.

    Texts are dealt into ranges of (id, hash of the text) once; each task sorts its range, encodes
    it and writes shards as it goes, so nothing larger than a shard is held and documents are in
    ascending id order over (part, seq). The range sample reads ids and hashes only.

    Defined cases: null texts are empty (the end id alone); null ids come first; documents of one
    id are ordered by their text's hash; any text length works; other columns are ignored; an empty
    table has no shards. Ids of documents must be integers.
    """

    def write(batches):
        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, counts, ids, held = [], [], [], 0

        def shut():
            nonlocal names, counts, ids, held, seq
            raw = image(names, np.concatenate(counts), np.concatenate(ids), coder.width)
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (len(names), pa.int64()), (held, pa.int64()), (raw, pa.binary()))], ["part", "seq", "n_docs", "n_ids", "image"])
            names, counts, ids, held, seq = [], [], [], 0, seq + 1
            return out

        for batch, col in steps(batches, ENCODE_BYTES):
            got, n = coder.batch(col, end)
            names += batch.column(0).to_pylist()
            counts.append(n)
            ids.append(got)
            held += len(got)
            if held >= shard_ids:
                yield shut()
        if names:
            yield shut()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return table(rows.mapInArrow(write, "part int, seq int, n_docs long, n_ids long, image binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for part, seq, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                shard = Shard(raw.as_py())
                ends = shard.ends.decode().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = shard.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids(), pa.int64()), pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), int64(starts), int64(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "seq", "_start", "n_tokens", "ids_crc32"],
                )

    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part"))
    seqs = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_seq"))
    base = seqs.join(parts, "part").select("part", "seq", (F.col("_part") + F.col("_seq")).alias("_base"))
    docs = shards.select("part", "seq", "image").mapInArrow(read, "doc_id long, part int, seq int, _start long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
