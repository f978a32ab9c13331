import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from ledgerlens.llm import queries as Q
from ledgerlens.llm.common import SPACE, SpanHash, Words, ngram_hash, sliding_min, table
from ledgerlens.llm.compression import fit_language, fit_toxicity, identify_language, score_toxicity
from ledgerlens.llm.decontaminate import decontaminate
from ledgerlens.llm.elias_fano import EliasFano
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.lm import score_texts
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.ngram_join import jaccard_components
from ledgerlens.llm.rules import fit_quality, score_quality
from ledgerlens.llm.substring_dedup import remove_repeats
from ledgerlens.llm.token_files import Encoder, Shard, image, read_shards, write_shards

SPEC = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, spans string, items string, size long, node string, label string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=True):
    """(doc_id, text) rows, with columns whose names operators use themselves."""
    full = [(i, t, "en", None if i is None or i % 3 else "s", 1, 0.5, 7, "x", "y", 3, "n", "l") for i, t in rows]
    df = spark.createDataFrame(full, SPEC)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


LONG = " ".join(f"w{i}" for i in range(3000))
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "a b c " * 40), (6, "a b c " * 40), (7, LONG), (8, LONG + " tail"), (9, "é ́x İ 中文 😀"), (10, "x" * 200_000)]


def lower(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_twin(spark, sf_dir, name):
    same(spark, Q.queries()[name], Q.oracle_sql()[name], sf_dir)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- helpers


def test_words_and_hashes():
    texts = ["  One two x\tTWO", "", "one", "é!"]
    w = Words(pa.array(texts), SPACE, True)
    assert [w.text(i) for i in range(len(w))] == [x for t in texts for x in WORDS.findall(lower(t))]
    h = w.hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == len({w.text(i) for i in range(len(w))})
    spans = SpanHash(np.concatenate([h, h]))
    n = len(h)
    assert spans(np.array([1]), np.array([3])) == spans(np.array([1 + n]), np.array([3 + n]))
    a = np.array([5, 3, 4, 1, 2, 6, 0], np.uint64)
    assert sliding_min(a, 3).tolist() == [3, 1, 1, 1, 0]
    assert len(ngram_hash(h, 3)) == n - 2


def test_elias_fano_round_trip():
    rng = random.Random(1)
    for n, top in ((0, 1), (1, 1), (5, 10), (3000, 3000), (3000, 1 << 40), (2000, 7)):
        values = np.array(sorted(rng.randrange(top) for _ in range(n)), np.uint64)
        e, end = EliasFano.from_bytes(b"x" + EliasFano.encode(values, top).to_bytes(), 1)
        assert (e.decode() == values).all()
        assert [e.select(i) for i in range(n)] == values.tolist()
        if n and top >= n:
            assert 8 * (len(e.lows) + len(e.highs)) <= n * (3 + math.log2(top / n)) + 16


def test_shard_round_trip():
    ids = np.arange(50, dtype=np.uint32)
    s = Shard(image([None, -5, 3, 3], np.array([1, 9, 0, 40]), ids, 2))
    assert s.doc_ids() == [None, -5, 3, 3]
    assert [s.span(k) for k in range(4)] == [(0, 1), (1, 10), (10, 10), (10, 50)]
    assert (s.ids == ids).all()


def test_encoder_equals_whole_texts():
    e = Encoder(Q.tokenizer_path())
    rng = random.Random(2)
    parts = ["a", "b", "I'm", "|", "||", "<|endoftext|>", " ", "\n", " ", "é", "́", "É", "ß", "12", "3", "!!", "😀", "中文", "\x1c", "\x85", "\x00", "İ", "'s", "x.y", "don't!'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "a|b | |"]
    for some in (texts, [t for t in texts if "<|" not in t]):
        ids, n = e.batch(pa.array(some), 2)
        want = [x.ids + [2] for x in e.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


# ---- brute force and accuracy


def test_lm_base_and_gain(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs_of(spark, sf_dir).collect()]
    tokens = {i: WORDS.findall(lower(t)) + [b"\n"] for i, t in rows}
    train = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(t)
    n, v = sum(train.values()), len(train)
    gain = 0.0
    for r in Q.op2_lm_scoring(spark, sf_dir).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(train[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_lm_against_plain_python(spark):
    """Counts, mixture weights and scores from dictionaries and loops; and each context's probabilities sum to 1."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(vocab[min(39, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(1000 + i, f"new{i} w1 w2") for i in range(30)] + [(2000, None), (2001, "")]
    part = {i: {2: 2, 3: 1}.get(zlib.crc32(str(i).encode()) % 7, 0) for i, _ in rows}
    text = {i: ["<begin>", *(t or "").lower().split(), "<end>"] for i, t in rows}

    def count(parts):
        one, two, begin = Counter(), Counter(), 0
        for i, t in text.items():
            if part[i] in parts:
                one.update(t[1:])
                two.update(zip(t, t[1:], strict=False))
                begin += 1
        return one | Counter({"<begin>": begin}), two, sum(one.values())

    (one, two, n), (own, own_two, own_n) = count({0, 1}), count({0})
    v = len(one) - 1
    bucket = lambda c: int(math.log2(c)) + 1 if c else 0
    step = lambda p: 2 ** (-round(-8 * math.log2(p)) / 8) if p else 0.0
    cells = Counter()
    for i, t in text.items():
        if part[i] == 1:
            for a, b in zip(t, t[1:], strict=False):
                cells[bucket(own[a]), step(own_two[a, b] / max(1, own[a])), step(own[b] / own_n)] += 1
    weight = {b: [0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3 for b in range(66)}
    for _ in range(60):
        got = {b: [0.0] * 3 for b in weight}
        for (b, x, y), k in cells.items():
            mix = [w * p for w, p in zip(weight[b], (x, y, 1 / (v + 1)), strict=True)]
            for j in range(3):
                got[b][j] += k * mix[j] / sum(mix)
        whole = [sum(g[j] for g in got.values()) for j in range(3)]
        for b, g in got.items():
            g = [g[j] + (0 if b == 0 and j == 0 else 1 + whole[j] / sum(whole)) for j in range(3)]
            weight[b] = [x / sum(g) for x in g]

    def p(a, b):
        w = weight[bucket(one[a])]
        return w[0] * two[a, b] / max(1, one[a]) + w[1] * (one[b] if b != "<begin>" else 0) / n + w[2] / (v + 1)

    for a in ("<begin>", "w0", "w39", "never"):
        assert sum(p(a, b) for b in one if b != "<begin>") + p(a, "unseen word") == pytest.approx(1)
    for r in score_texts(frame(spark, rows)).collect():
        t = text[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(t, t[1:], strict=False)), rel=1e-9)


def test_lm_unseen_words_keep_a_share():
    """A bucket whose held-out tokens were all known still leaves the uniform part a weight."""
    from ledgerlens.llm.lm import learn_weights

    w = learn_weights(np.array([[5, 8, 40, 1000], [0, -1, 24, 5]]), 1e-7)
    assert w[0, 0] == 0 and (w[:, 1:] > 1e-4).all() and np.allclose(w.sum(1), 1)


def test_lm_prefers_what_it_has_seen(spark):
    base = [(i, "the cat sat on the mat") for i in range(60)]
    ids = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    probe = list(zip(ids, ["the cat sat", "sat cat the", "zzz cat sat"], strict=True))
    got = {r.doc_id: r for r in score_texts(frame(spark, base + probe)).collect()}
    a, b, c = (got[i].score for i in ids)
    assert 0 > a > b and a > c and got[ids[2]].n_known == 3


def held_accuracy(spark, sf_dir, name, column):
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = Q.queries()[name](spark, sf_dir).join(lab, "doc_id").filter("held_out")
    return out.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    assert held_accuracy(spark, sf, "op4_toxicity", "toxic") > 0.9
    assert held_accuracy(spark, sf, "op8_quality", "quality") > 0.9
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    ok = Q.op7_language(spark, sf).join(lang, "doc_id").filter("held_out AND lang_pred <> 'und'").agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("double"))).first()[0]
    assert ok > 0.95


def plain_sizes(content, min_match, windows, **options):
    """Compressed sizes by zstandard alone."""
    import zstandard

    given = {"search_log": 3, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2} | options
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, min_match=min_match, write_content_size=False, write_checksum=False, write_dict_id=False, **given
    )
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return [len(zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress(x)) for x in windows]


def test_toxicity_scores_by_zstandard_alone(spark, sf_dir):
    """Each word between edges, its sizes under both dictionaries, what their differences say and the curve, one text after the other."""
    import zstandard

    from ledgerlens.llm.compression import EDGE, MARK

    docs = docs_of(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fine = {"search_log": 4, "target_length": 64, "strategy": zstandard.STRATEGY_BTOPT}
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    for r in list(got.values())[::11]:
        windows = [MARK + EDGE + x + EDGE for x in WORDS.findall(lower(r.text))]
        sizes = [plain_sizes(m.content, 5, windows, **fine) for m in (model.plain, model.toxic)]
        gain = [min(12, max(-8, p - t)) for p, t in zip(*sizes, strict=True)]
        said, hits, n = sum(model.says[g + 8] for g in gain), sum(g >= model.threshold for g in gain), len(gain)
        x = [said, said / math.sqrt(n + 10), math.log1p(hits), math.log(1 + 100 * hits / (n + 20)), math.log1p(n) / 2, 1.0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.curve, strict=True)))), rel=1e-9)


def test_both_dictionaries_have_text_of_their_class(spark):
    """Telling words recur in different surroundings, copies of a text do not make them, and both own parts are as long."""
    from ledgerlens.llm.compression import EDGE, ToxicityModel, telling_words

    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(80))
    plain = [prose() for _ in range(200)]
    toxic = [t + " " + " ".join(rng.choice(["vilest", "rotten"]) + " " + " ".join(prose().split()[:3]) for _ in range(4)) for t in (prose() for _ in range(200))]
    copied = prose() + " onlycopied " + prose()
    assert set(telling_words(toxic + [copied] * 30, plain, 3, 3.5, 3)) == {b"vilest", b"rotten"}
    model = ToxicityModel().fit(toxic[:150], plain[:150])
    common = len(os.path.commonprefix([model.toxic.content[::-1], model.plain.content[::-1]]))
    own = [m.content[: len(m.content) - common].split(EDGE) for m in (model.toxic, model.plain)]
    texts = [" ".join(x).encode() for x in (toxic, plain)]
    sizes = [sum(len(w) for w in x) for x in own]
    assert all(w in text for x, text in zip(own, texts, strict=True) for w in x) and 0 < sizes[0] and sizes[1] > 0.5 * sizes[0]
    score = model.scores(pa.array(toxic[150:] + plain[150:]))
    assert (score[:50] > 0.9).all() and (score[50:] < 0.1).all()


def test_toxicity_in_every_language(spark):
    """Held-out recall by class and language at the query's own cut."""
    sf = "/root/testdata/sf0.1"
    seen = Q.op4_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    seen = seen.join(docs_of(spark, sf).select("doc_id", "lang"), "doc_id").groupBy("lang", "toxic").agg(F.avg("predicted").alias("rate"), F.count("*").alias("n"))
    rows = {(r.lang, r.toxic): (r.rate, r.n) for r in seen.collect()}
    mean = lambda y: sum(a * n for (_, t), (a, n) in rows.items() if t == y) / sum(n for (_, t), (_, n) in rows.items() if t == y)
    assert mean(1) >= 0.9 and mean(0) <= 0.02
    assert all(rate >= 0.8 for (_, y), (rate, _) in rows.items() if y == 1)


def test_languages_by_zstandard_alone(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = fit_language(docs)
    for r in identify_language(docs, model).collect()[::13]:
        text = (r.text or "").lower().encode()
        windows = [text[k : k + 1024] for k in range(0, len(text), 1024)] or [b""]
        total = [sum(plain_sizes(s.content, 3, windows)) for s in model.sizes]
        if any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == model.langs[total.index(min(total))]
            assert r.score == pytest.approx(1 / sum(2.0 ** -min(40, t - min(total)) for t in total))
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_quality_expression_equals_the_rules(spark, sf_dir):
    from ledgerlens.llm.rules import NAMES, statistics

    docs = docs_of(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = statistics(F.col("text"))
    rows = score_quality(docs, model).select("score", *(stats[n].cast("double").alias(n) for n in NAMES)).toPandas()
    assert len(model.rules) > 0
    assert np.allclose(rows["score"], model.predict(rows[NAMES].to_numpy(float)), rtol=1e-9)


def test_labels_that_disagree(spark):
    """The larger of two labels of one id counts, whatever the order of rows."""
    d = spark.createDataFrame([(i, ("spam " if i % 2 else "fine words here ") * 20) for i in range(200)], "doc_id long, text string")
    pairs = [(i, i % 2, i % 2) for i in range(200)] + [(i, 0, 0) for i in range(1, 200, 2)]
    scores = []
    for order in (pairs, pairs[::-1]):
        labels = spark.createDataFrame(order, "doc_id long, quality int, toxic int")
        scores.append([r.score for r in score_quality(d, fit_quality(d, labels)).orderBy("doc_id").collect()])
        got = [r.score for r in score_toxicity(d, fit_toxicity(d, labels)).orderBy("doc_id").collect()]
        assert min(got[1::2]) > max(got[::2])
    assert scores[0] == scores[1] and min(scores[0][1::2]) > max(scores[0][::2])


def test_other_tokenizers_encode_whole_texts(spark):
    """A tokenizer that keeps case and white space: ids of whole texts, as its library gives them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    assert not Encoder(path).by_pieces and Encoder(Q.tokenizer_path()).by_pieces
    rows = [(i, x) for i, x in enumerate([None, "", "  Two  Words\n12345", "é 中文 IT'S", "a|b | c"])]
    start = 0
    for r in read_shards(write_shards(frame(spark, rows), path)).orderBy("doc_id").collect():
        ids = t.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_against_whole_texts(spark, sf_dir):
    e = Encoder(Q.tokenizer_path())
    start = 0
    got = {r.doc_id: r for r in Q.op10_token_files(spark, sf_dir).collect()}
    for r in sorted(docs_of(spark, sf_dir).collect(), key=lambda r: r.doc_id):
        ids = e.tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def components_by_force(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard_against_brute_force(spark, k, num, den):
    rng = random.Random(k)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq")
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), k, num, den).collect()}
    assert got == components_by_force(rows, k, num, den)


@pytest.mark.parametrize("apart", [False, True])
def test_large_groups_meet_in_blocks(spark, monkeypatch, apart):
    """One group in many blocks: with all sets linked, and with two halves that share half their words."""
    import ledgerlens.llm.ngram_join as J

    monkeypatch.setattr(J, "BLOCK_SHINGLES", 200)
    rng = random.Random(5)
    base = [[f"w{j}" if j < 30 or not apart else f"{side}{j}" for j in range(60)] for side in "ab"]
    rows = []
    for i in range(25):
        t = list(base[i % 2])
        t[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), 3, 9, 10).collect()}
    assert got == components_by_force(rows, 3, 9, 10)
    nodes = [(i, 0, 58) for i, _ in rows]
    groups = spark.createDataFrame(nodes, "node long, label long, n long")  # all candidates of each other
    links = {(r.a, r.b) for r in J.verified_links(frame(spark, rows).select("doc_id", "text"), groups, 3, 9, 10).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t in rows}
    assert all(10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]) for a, b in links)
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert label == {i: r for i, (_, r) in components_by_force(rows, 3, 9, 10).items()}


def test_long_sets_are_joined_by_parts(spark):
    """Sizes on both sides of the cuts into parts, and similarities on both sides of the threshold."""
    rng = random.Random(11)
    rows = []
    for size in (900, 1024, 1100, 2000, 2060, 2300, 4090, 4200):
        base = [f"v{rng.randrange(10**6)}" for _ in range(size + 2)]
        for share in (0.0, 0.02, 0.03, 0.035, 0.04, 0.1):
            t = [f"u{rng.randrange(10**6)}" if rng.random() < share else x for x in base]
            rows.append((len(rows), " ".join(t)))
        rows.append((len(rows), " ".join(base[: int(size * 0.82)])))
        rows.append((len(rows), " ".join(base[: int(size * 0.78)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), 3, 4, 5).collect()}
    want = components_by_force(rows, 3, 4, 5)
    assert got == want
    assert len({r for _, r in want.values()}) < len(rows) - 20


def test_ids_must_be_whole_numbers(spark):
    d = frame(spark, [(1, "a")]).withColumn("doc_id", F.lit("x"))
    for f in (jaccard_components, remove_repeats, score_texts):
        with pytest.raises(TypeError, match="whole numbers"):
            f(d)


def test_decontaminate_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(f"q{i}w{j}" for j in range(15))) for i in range(6)] + [(90, "lone"), (91, "two words"), (92, ""), (None, "null item here")], "item_id long, text string")
    rows = [(i, "pre " + " ".join(f"q{i}w{j}" for j in range(2, 13)) + " post") for i in range(6)] + [(50, "a Lone-two, WORDS end"), (51, None), (52, "null item here")]
    one = {r.doc_id: (r.n_words, r.spans, r.items) for r in decontaminate(frame(spark, rows), items).collect()}
    many = {r.doc_id: (r.n_words, r.spans, r.items) for r in decontaminate(frame(spark, rows), items, block_rows=7).collect()}
    assert one == many
    assert one[0] == (13, [[1, 12]], ["0"])
    assert one[50] == (5, [[1, 4]], ["90", "91"])
    assert one[51] == (0, [], []) and one[52][2] == [""]


# ---- awkward rows: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables


def check(df, n=len(AWKWARD)):
    rows = df.collect()
    assert len(rows) == n
    return rows


def test_awkward_rows(spark):
    d = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(4, 9)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in check(exact_dedup(d, keep="max"))}
    assert (got[5].keep_id, got[5].group_size, got[5].kept) == (6, 2, False) and got[1].keep_id == 2
    assert {r.kept for r in check(exact_dedup(frame(spark, [(None, "x"), (None, "x")])), 2)} == {True}
    got = check(mix_sources(d))
    assert all(r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size for r in got)
    cut = {r.doc_id: r for r in check(remove_repeats(d)) if r.doc_id}
    assert cut[6].n_removed == 120 and cut[5].n_removed == 0 and cut[8].kept == "tail"
    for r in check(jaccard_components(d)):
        assert r.component_id == {1: 1, 6: 5, 5: 5, 8: 7}.get(r.doc_id, r.doc_id)
    check(score_texts(d))
    check(decontaminate(d, spark.createDataFrame([], "item_id long, text string")))
    assert all(0 <= r.score <= 1 for r in check(score_toxicity(d, fit_toxicity(d, labels))))
    assert all(0 <= r.score <= 1 for r in check(score_quality(d, fit_quality(d, labels))))
    lang = {r.doc_id: r.lang_pred for r in check(identify_language(d, fit_language(d)))}
    assert lang[1] == lang[2] == lang[3] == "und" and lang[7] == "en"
    ends = sorted((r.start, r.n_tokens) for r in check(read_shards(write_shards(d, Q.tokenizer_path()))))
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_collisions_are_told_apart(spark):
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, "c")]
    got = {r.doc_id: r.keep_id for r in exact_dedup(frame(spark, rows), keep="max", digest=lambda c: F.lit("00")).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4}


def test_empty_tables(spark):
    d = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    for df in (
        exact_dedup(d), mix_sources(d), remove_repeats(d), jaccard_components(d), score_texts(d), decontaminate(d, items), read_shards(write_shards(d, Q.tokenizer_path())),
        score_toxicity(d, fit_toxicity(d, labels)), score_quality(d, fit_quality(d, labels)), identify_language(d, fit_language(d)),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage against a plain version of its decision on its own input."""
    import corpus_pipeline as P

    docs = docs_of(spark, sf_dir)
    kept = []
    for name, stage in P.STAGES[:-1]:
        out = table(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, Counter(r.doc_id for r in out.collect())
        kept.append(sum(after.values()))
        if name == "toxicity":
            score = {r.doc_id: r.score for r in Q.op4_toxicity(spark, sf_dir).collect()}
            assert set(after) == {i for i in before if score[i] < P.TOXIC}
        elif name == "ngram_jaccard_join":
            want = components_by_force(list(before.items()), 5, 4, 5)
            assert set(after) == {i for i in before if want[i][1] == i}
        elif name == "benchmark_decontamination":
            words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
            bad = set()
            for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
                w = words(r.text)
                bad |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(b) for b in bad}
            hit = {i for i, t in before.items() if any(tuple(words(t)[k : k + n]) in bad for n in sizes for k in range(len(words(t)) - n + 1))}
            assert set(after) == set(before) - hit
        else:
            taken = {r.doc_id: r.taken // r.size if r.size else 1 for r in mix_sources(docs).collect()}
            assert after == Counter({i: n for i, n in taken.items() if n})
        docs = out
    got = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    e = Encoder(Q.tokenizer_path())
    want = Counter((r.doc_id, zlib.crc32(np.array(e.tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert P.run(spark, sf_dir).count() == len(got)
