"""Buckets of many contents, split or whole, remove the same words as a plain version does."""

import random

from ledgerlens.llm.substring_dedup import remove_repeats


def plain(docs, window):
    first, out = {}, {}
    for i, t in sorted(docs):
        words = t.split()
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    for i, t in docs:
        words = t.split()
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def test_split_buckets(spark):
    rng = random.Random(5)
    word = lambda n: f"w{rng.randrange(n)}"
    passage = [word(900) for _ in range(70)]
    other = [word(900) for _ in range(90)]
    docs = []
    for i in range(160):
        words = [word(30) for _ in range(rng.randrange(60))] + passage + [word(30) for _ in range(rng.randrange(60))]
        if i % 4 == 0:
            words += other[: rng.randrange(20, 90)]
        if i % 7 == 0:
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, docs[i][1]) for i in range(0, 160, 5)] + [(900, "a " * 400), (901, "a " * 300), (902, "")]
    want = plain(docs, 50)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (0, 20, 1 << 30):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, hot=hot).collect()}
        assert got == want, hot
