"""What split buckets ask of the texts is written before it meets them."""

from ledgerlens.llm import substring_dedup as sd


def test_lists_of_hot_contents_are_written_first(spark, monkeypatch):
    names, real = [], sd.table
    monkeypatch.setattr(sd, "table", lambda df, name: names.append(name) or real(df, name))
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(d, f"{' '.join(f'a{d}x{i}' for i in range(6))} {same} {' '.join(f'b{d}x{i}' for i in range(6))}") for d in range(6)]
    got = sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), 10, 4, hot=1).collect()
    assert {"hot-wanted", "hot-kept"} <= set(names)
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5}
    assert {i for r in got for s in r.spans for i in range(s.lo, s.hi)} == set(range(6, 18))
