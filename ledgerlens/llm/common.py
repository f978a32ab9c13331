"""Shared pieces: vectorised word splitting over Arrow batches, stage tables, bounded samples."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; the arrays of a step stay under 100 MB.
STEP_BYTES = 1 << 20

_ALL = np.arange(256)
#: Bytes between words: ASCII white space.
SPACE = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
#: Bytes between words: every ASCII character but letters and digits. Bytes of other characters belong to words.
PUNCT = (_ALL < 0x80) & ~(((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)))
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- Spark side


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast path: there both functions agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def long_id(df: DataFrame, name: str) -> Column:
    """The id column as long; ids that are not whole numbers are refused."""
    kind = df.select(name).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{name} is of type {kind}; ids must be whole numbers")
    return F.col(name).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for x in names:
        while x.lower() in taken:
            x = "_" + x
        out.append(x)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local master may go without one."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Lists that take the paths of stage tables as they are written; see recording().
_recorders: list[list[str]] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for r in _recorders:
        r.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recording():
    """The paths of the stage tables written inside, to be given to discard() once nothing reads them."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [r for r in _recorders if r is not paths]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stage tables, through the file system that holds them."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---- executor side


def steps(batches, size: int = STEP_BYTES, column: str = "text"):
    """Cuts Arrow batches into runs of rows whose texts hold about ``size`` bytes (a longer text stands alone)."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        if batch.num_rows == 0:
            continue
        col = batch.column(k)
        if col.null_count:
            col = col.fill_null("")
        if pa.types.is_large_string(col.type):
            col = col.cast(pa.string())
        off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), col.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a run of texts: their bytes' spans, texts and 64-bit hashes.

    ``first[d]:first[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, col: pa.Array, sep: np.ndarray, lower: bool):
        n = len(col)
        off = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
        buf = col.buffers()[2]
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data = LOWER[data] if lower else data
        self.off = off
        word = ~sep[data]
        s, e = word.copy(), word.copy()
        s[1:] &= ~word[:-1]
        e[:-1] &= ~word[1:]
        full = off[1:] > off[:-1]
        p, q = off[:-1][full], off[1:][full] - 1
        s[p], e[q] = word[p], word[q]
        self.starts, self.ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.starts, off)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self._word = word

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        power = np.full(int(lens.max()), 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        vals = self.data[self._word].astype(np.uint64) + np.uint64(1)
        vals *= power[np.arange(len(vals)) - np.repeat(at, lens)]
        return mix64(np.add.reduceat(vals, at) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words (told apart by all their bytes) and the number of each word among them."""
        size = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        letters = np.ascontiguousarray(self.data[self._word])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(size), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1, one space between."""
        return b" ".join(self.data[self.starts[lo] : self.ends[hi - 1]].tobytes().split()) if hi > lo else b""


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m] + np.uint64(k + 1))
    return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    out, span = a, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


class SpanHash:
    """128-bit hashes of runs of words, from prefix sums of two polynomials in the words' hashes."""

    RATIOS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, h: np.ndarray):
        self.parts = []
        for k, r in enumerate(self.RATIOS):
            inverse = pow(r, -1, 1 << 64)
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), x, np.uint64)]), dtype=np.uint64) for x in (r, inverse))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(k)) * up[:-1], dtype=np.uint64)])
            self.parts.append((sums, down))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (hi - lo).astype(np.uint64)
        a, b = (mix64((s[hi] - s[lo]) * down[lo] + n) for s, down in self.parts)
        return a, b
