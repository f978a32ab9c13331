"""Compression against raw-content zstandard dictionaries: toxicity and language of whole texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, fold, mix64, steps, table

#: A text of this toxicity score or more is toxic.
TOXIC = 0.7
#: Bytes of sampled text that training holds on the driver.
SAMPLE_BYTES = 48 << 20
#: The least part of them that each class has, however many there are.
LEAST_BYTES = 64 << 10


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", max_bytes: int = SAMPLE_BYTES) -> dict:
    """label -> texts: at most ``per_class`` whole texts a label in the order of a hash of the id.

    Each label has an equal part of ``max_bytes`` of its own, at least ``LEAST_BYTES``, spent in that order by the
    texts' lengths; a text beyond what is left of it is skipped. A label of which all texts are longer
    than its part has the start of the first. ``labels``: id and label, already restricted to the
    learning fold. Ids and lengths are picked first, so only the sample's texts reach the driver; of ids only those under the bar do.
    """
    known = labels.filter(F.col("label").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), "label").dropDuplicates(["_id", "label"])
    texts = docs.filter("text IS NOT NULL").select(F.col(id_col).alias("_id"), "text")
    # Labels of ids without a text take no place in the sample.
    length = texts.groupBy("_id").agg(F.sum(F.octet_length("text")).alias("n"))
    present = table(known.join(length, "_id").withColumn("_rank", F.xxhash64("_id")), "labelled")
    # Of a frequent label only hashes below a bar that some more than per_class pass go on: few, whatever the label's size.
    share = F.least(F.lit(1.0), F.lit(1.25 * per_class + 64) / F.col("_n"))
    counts = present.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    sized = present.join(counts, "label").filter(F.col("_rank").cast("double") <= share * 2.0**64 - 2.0**63)
    sized = sized.select("_id", "label", "_rank", "n").collect()
    out: dict = {r.label: [] for r in sized}
    if not out:
        return out
    part = max(max_bytes // len(out), LEAST_BYTES)
    left, first = dict.fromkeys(out, part), {}
    seen: Counter = Counter()
    chosen = []
    for r in sorted(sized, key=lambda r: (r["_rank"], r["_id"])):
        seen[r.label] += 1
        if seen[r.label] > per_class:
            continue
        first.setdefault(r.label, r)
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            chosen.append(r)
    chosen += [first[c] for c in out.keys() - {r.label for r in chosen}]
    picked = docs.sparkSession.createDataFrame([(r["_id"], r.label, r["_rank"]) for r in chosen], present.select("_id", "label", "_rank").schema)
    held = dict.fromkeys(out, 0)
    cut = F.when(F.octet_length("text") <= part, F.col("text")).otherwise(F.substring("text", 1, part // 4))  # a character has at most four bytes
    for r in texts.join(F.broadcast(picked), "_id").select("label", "_rank", cut.alias("text")).toLocalIterator():
        if not out[r.label] or held[r.label] + len(r.text) <= part:  # beyond it only where rows of one id add up
            held[r.label] += len(r.text)
            out[r.label].append((r["_rank"], r.text))
    return {c: [t for _, t in sorted(v)] for c, v in out.items()}


class Sizes:
    """Compressed sizes of many windows under one raw-content dictionary."""

    def __init__(self, content: bytes, min_match: int):
        self.content, self.min_match = content, min_match
        self._c = None

    def __getstate__(self):
        return {"content": self.content, "min_match": self.min_match, "_c": None}

    #: Of small windows: no frame fields, and a lazy search.
    OPTIONS = {
        "window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 3, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2,
        "write_content_size": False, "write_checksum": False, "write_dict_id": False,
    }

    def compressor(self) -> zstandard.ZstdCompressor:
        if self._c is None:
            params = zstandard.ZstdCompressionParameters(min_match=self.min_match, **self.OPTIONS)
            raw = zstandard.ZstdCompressionDict(self.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            self._c = zstandard.ZstdCompressor(dict_data=raw, compression_params=params)
        return self._c

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        compress, view = self.compressor().compress, memoryview(np.ascontiguousarray(data))
        return np.fromiter((len(compress(view[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))


# ---- samples of running text


def spans(texts: list[bytes], size: int, least: int = 64) -> bytes:
    """``size`` bytes of the texts at most: short texts whole, of each other one span of equal length, ``least`` or
    more, from an offset given by the text's hash, so that openings count no more than the rest."""
    texts = [t for t in texts if t][: max(1, size // (least + 1))]
    share, left = 0, size - len(texts)
    for k, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - k)
        if n > share:
            break
        left -= n
        share = n
    out = []
    for t in texts:
        at = zlib.crc32(t) % (len(t) - share + 1) if len(t) > share else 0
        out.append(t[at : at + share].decode(errors="ignore").encode())
    return b"\n".join(out)


# ---- toxicity


def word_windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-to-back windows of ``size`` words (the last may be shorter): bytes from, bytes to, text.
    A window starts at the white space before its first word where there is one."""
    first = w.first
    n = np.diff(first)
    count = -(-n // size)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    lo = first[doc] + k * size
    hi = np.minimum(lo + size, first[doc + 1])
    a, b = w.starts[lo], w.ends[hi - 1]
    return np.maximum(a - 1, w.off[doc]), np.minimum(b + 1, w.off[doc + 1]), doc


def common_part(texts: list[str], size: int, window: int = 12) -> bytes:
    """Raw content trained by zstandard on windows of running text; of little text its end."""
    w = Words(pa.array(texts, pa.string()), SPACE, True)
    a, b, _ = word_windows(w, window)
    raw = w.data.tobytes()
    samples = [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    if len(raw) > 16 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()
        except zstandard.ZstdError:  # too little variety to train on
            pass
    return raw[-size:]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.5) -> np.ndarray:
    """Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


#: Stands before and after every word: a match that takes in a word's edge is longer than one inside a word.
EDGE = b"    "
#: Stands before every window, and both dictionaries end in it: the fixed costs of a frame are the same under both.
MARK = b"\x01window\x02begin\x03"


class WordSizes(Sizes):
    """Compressed sizes of single words between edges, under one raw-content dictionary."""

    OPTIONS = Sizes.OPTIONS | {"search_log": 4, "target_length": 64, "strategy": zstandard.STRATEGY_BTOPT}

    def __init__(self, own: list[bytes], common: list[bytes], min_match: int):
        super().__init__(EDGE.join([b"", *own, *common, b""]) + MARK, min_match)

    def words(self, words: list[bytes]) -> np.ndarray:
        compress = self.compressor().compress
        return np.fromiter((len(compress(MARK + EDGE + x + EDGE)) for x in words), np.int64, len(words))


def surroundings(w: Words, code: np.ndarray, kinds: int) -> np.ndarray:
    """In how many different surroundings (the word before, the word after) each word occurs: copies count once."""
    h = w.hashes()
    first, last = np.zeros(len(w), bool), np.zeros(len(w), bool)
    full = w.first[1:] > w.first[:-1]
    first[w.first[:-1][full]], last[w.first[1:][full] - 1] = True, True
    before = np.where(first, np.uint64(0), np.roll(h, 1))
    after = np.where(last, np.uint64(0), np.roll(h, -1))
    _, at = np.unique(mix64(mix64(before + np.uint64(1)) + np.uint64(3) * mix64(h)) + np.uint64(5) * after, return_index=True)
    return np.bincount(code[at], minlength=kinds)


def telling_words(toxic: list[str], plain: list[str], least: int, z: float, ratio: float) -> list[bytes]:
    """Words of the toxic running text that recur there in ``least`` surroundings, significantly and ``ratio`` times more
    often than in the ordinary one; the most telling first."""
    w = Words(pa.array(toxic + plain, pa.string()), SPACE, True)
    values, code = w.distinct()
    edge = int(w.first[len(toxic)])
    n, m = (surroundings(Words(pa.array(x, pa.string()), SPACE, True), c, len(values)) for x, c in ((toxic, code[:edge]), (plain, code[edge:])))
    p, q = n / max(1, n.sum()), m / max(1, m.sum())
    mean = (n + m + 1) / (n.sum() + m.sum())
    score = (p - q) / np.sqrt(mean * (1 / max(1, n.sum()) + 1 / max(1, m.sum())))
    found = np.flatnonzero((n >= least) & (score >= z) & (p > ratio * q))
    return [values[int(k)].as_py() for k in found[np.argsort(q[found] - p[found], kind="stable")]]


class ToxicityModel:
    """A dictionary of each class, the likelihood ratio of each difference of a window's two sizes, and a logistic curve.

    Each dictionary has a part of its own class's text, of equal size, and then a common part that zstandard trains
    on ordinary text, so what toxic and ordinary texts share costs the same under both. The toxic
    part is what recurs in toxic texts and seldom elsewhere (toxic texts are ordinary prose for the most part); the
    ordinary part is running text from all over the ordinary sample. A window is one word: its sizes under
    both dictionaries are compared, and a held-out fifth of the sample calibrates what each difference says and
    how a text's windows add up.
    """

    def __init__(self, own_bytes: int = 8 << 10, common_bytes: int = 8 << 10, min_match: int = 5, least: int = 3, z: float = 3.5, ratio: float = 3.0):
        self.own_bytes, self.common_bytes, self.min_match = own_bytes, common_bytes, min_match
        self.least, self.z, self.ratio = least, z, ratio
        self.prior = 0.0
        self.toxic = self.plain = None
        self._met: dict[bytes, int] = {}

    #: Differences from -LOW to HIGH bytes are told apart.
    LOW, HIGH = 8, 12
    #: Words whose difference a worker remembers, and the longest of them in bytes: some 30 MB.
    REMEMBERED, LONGEST = 1 << 18, 48

    def __getstate__(self):
        return self.__dict__ | {"_met": {}}

    def fit(self, toxic: list[str], plain: list[str]) -> ToxicityModel:
        if not toxic or not plain:
            self.prior = 0.0 if plain or not toxic else 1.0
            return self
        # Every fifth text (of few texts every fourth) calibrates, the others make the dictionaries.
        nth = 5 if min(len(toxic), len(plain)) >= 500 else 4
        cut = lambda x, held: [t for i, t in enumerate(x) if (i % nth == nth - 1) == held]
        sides = [cut(x, False) or x for x in (toxic, plain)]
        telling, room = [], self.own_bytes
        for word in telling_words(*sides, self.least, self.z, self.ratio):
            room -= len(word) + 1
            if room < 0:
                break
            telling.append(word)
        ordinary = spans([t.lower().encode() for t in sides[1]], sum(len(x) + 1 for x in telling), 24).split()
        common = common_part(sides[1], self.common_bytes).split()
        # the most telling come last, nearest to the window
        self._met = {}
        self.toxic, self.plain = WordSizes(telling[::-1], common, self.min_match), WordSizes(ordinary, common, self.min_match)
        held = [cut(toxic, True) or toxic, cut(plain, True) or plain]
        windows = [self.differences(pa.array(x, pa.string())) for x in held]
        share = [np.bincount(d + self.LOW, minlength=self.LOW + self.HIGH + 1) + 0.5 for d, _ in windows]
        self.says = np.log(share[0] / share[0].sum()) - np.log(share[1] / share[1].sum())
        strong = np.flatnonzero(self.says[self.LOW + 1 :] > 1.0)
        self.threshold = int(strong[0]) + 1 if len(strong) else self.HIGH
        x = np.concatenate([self.features(*w, len(t)) for w, t in zip(windows, held, strict=True)])
        y = np.concatenate([np.ones(len(held[0])), np.zeros(len(held[1]))])
        weight = np.where(y == 1, 1 / len(held[0]), 1 / len(held[1])) * len(y) / 2
        self.curve = fit_logistic(x, y, weight)
        return self

    def differences(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes less each word takes under the toxic dictionary, and its text. Equal words are compressed once
        while a worker remembers them."""
        w = Words(col, SPACE, True)
        values, code = w.distinct()
        words = values.to_pylist()
        new = [x for x in words if x not in self._met]
        d = np.clip(self.plain.words(new) - self.toxic.words(new), -self.LOW, self.HIGH).tolist()
        now = dict(zip(new, d, strict=True))
        found = np.fromiter((now[x] if x in now else self._met[x] for x in words), np.int64, len(words))
        if len(self._met) + len(now) > self.REMEMBERED:
            self._met.clear()
        self._met.update((x, y) for x, y in now.items() if len(x) <= self.LONGEST)
        return found[code], w.doc

    def features(self, d: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Of each text: the sum of what its windows say, also by its length, and how many pass the threshold."""
        size = np.bincount(doc, minlength=n)
        said = np.bincount(doc, weights=self.says[d + self.LOW], minlength=n)
        hits = np.bincount(doc[d >= self.threshold], minlength=n)
        return np.column_stack([said, said / np.sqrt(size + 10), np.log1p(hits), np.log(1 + 100 * hits / (size + 20)), np.log1p(size) / 2])

    def scores(self, col: pa.Array) -> np.ndarray:
        if self.toxic is None:
            return np.full(len(col), self.prior)
        x = self.features(*self.differences(col), len(col))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.curve, -30, 30)))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = 3000, mod: int = 3, held: int = 1, id_col: str = "doc_id", max_bytes: int = 8 << 20
) -> ToxicityModel:
    """Learns from at most ``per_class`` labelled texts a class, half of ``max_bytes`` each, of ids whose
    crc32 modulo ``mod`` is not ``held``.

    Texts that a document and its copies share are sampled like any others; rows without label,
    id or text are not used; of labels of one id that disagree the largest counts. With one class or none the model gives that class's constant (0 without any).
    """
    learn = labels.filter(fold(F.col(id_col), mod) != held).groupBy(id_col).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    sample = labelled_sample(docs, learn, per_class, id_col, max_bytes)
    return ToxicityModel().fit(sample.get(1, []), sample.get(0, []))


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """Adds ``out`` (0 to 1) to the input rows; all windows of the whole text count.

    Defined cases: null and empty texts have no windows and get the curve's value for none; an input
    column of the name ``out`` is replaced; repeated rows score alike; an empty table stays empty.
    """
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries, under 100 KB

    def score(batches):
        for batch, col in steps(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(col), pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(score, docs.withColumn(out, F.lit(0.0)).schema)


# ---- language


class LanguageModel:
    """A raw-content dictionary of each language; the smallest compressed size wins."""

    def __init__(self, window_bytes: int = 1024, dict_bytes: int = 48 << 10, min_margin: float = 0.002):
        self.window_bytes, self.dict_bytes, self.min_margin = window_bytes, dict_bytes, min_margin
        self.langs: list[str] = []

    def fit(self, texts: dict[str, list[str]]) -> LanguageModel:
        texts = {k: v for k, v in texts.items() if any(t.strip() for t in v)}
        self.langs = sorted(texts)
        self.sizes = []
        for lang in self.langs:
            self.sizes.append(Sizes(spans([t.lower().encode() for t in texts[lang]], self.dict_bytes), 3))
        return self

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and relative margin of each text."""
        w = Words(pa.array([t.lower() for t in col.to_pylist()], pa.string()), SPACE, False)
        n = np.diff(w.off)
        count = np.maximum(1, -(-n // self.window_bytes))
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        a = w.off[doc] + k * self.window_bytes
        b = np.minimum(a + self.window_bytes, w.off[doc + 1])
        total = np.stack([np.bincount(doc, s(w.data, a, b), len(n)) for s in self.sizes])
        best = total.argmin(0)
        gap = total - total.min(0)
        margin = np.sort(gap, 0)[1] / np.maximum(n, 1) if len(self.langs) > 1 else np.ones(len(n))
        # one byte saved in a text doubles the odds, at most 40 bytes count
        return best, 1 / np.exp2(-np.minimum(gap, 40)).sum(0), margin


def fit_language(docs: DataFrame, per_class: int = 400, mod: int = 4, held: int = 2, id_col: str = "doc_id") -> LanguageModel:
    """Learns from at most ``per_class`` texts of each non-null language, of ids whose crc32 modulo ``mod`` is not ``held``."""
    learn = docs.filter((fold(F.col(id_col), mod) != held) & F.col("text").isNotNull()).select(id_col, F.col("lang").alias("label"))
    return LanguageModel().fit(labelled_sample(docs, learn, per_class, id_col))


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score (0 to 1), margin (bytes saved a byte against the runner-up) and reliable
    (margin >= the model's least margin: narrow results are rejected there and keep their best guess).

    Defined cases: texts that are null or have no letter are ``und`` with score 0, and so is
    everything where no language was learned; ties go to the first language in code point order;
    input columns of those names are replaced; texts are read whole, in windows.
    """
    docs = docs.drop("lang_pred", "score", "margin", "reliable").withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def identify(batches):
        m: LanguageModel = sent.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch, col in steps(batches):
            ok = np.asarray(batch.column(batch.schema.get_field_index("_letter")).to_numpy(zero_copy_only=False), bool)
            best, score, margin = m.predict(col) if m.langs else (np.zeros(len(col), int), np.zeros(len(col)), np.zeros(len(col)))
            ok = ok & bool(m.langs)
            best = np.where(ok, best, len(m.langs))
            score, margin = np.where(ok, score, 0.0), np.where(ok, margin, 0.0)
            out = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(margin), pa.array(margin >= m.min_margin) if m.langs else pa.array([False] * len(col))]
            keep = [i for i, f in enumerate(batch.schema.names) if f != "_letter"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *out], [*(batch.schema.names[i] for i in keep), "lang_pred", "score", "margin", "reliable"])

    schema = docs.drop("_letter").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "margin": F.lit(0.0), "reliable": F.lit(True)}).schema
    return docs.mapInArrow(identify, schema)
