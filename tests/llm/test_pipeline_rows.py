"""The near-duplicate stage keeps one row of each component, whatever the rows' ids."""

import corpus_pipeline

# B and C share some n-grams with A, too few to be near copies of it
A, B, C = (" ".join(f"{k if i > 9 else 'a'}{i}" for i in range(40)) for k in "abc")


def test_one_row_of_each_component_stays(spark, tmp_path):
    rows = [(1, A), (1, A), (2, B), (3, A), (3, C), (None, B), (None, A), (None, ""), (None, None), (5, ""), (None, C)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1] or "", r[1] is None)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(1, A), (2, B), (3, C), (None, ""), (None, None), (5, "")], key=key)


def test_the_mix_ties_copies_to_their_rows(spark):
    from codexa.llm import mixing

    rows = [(1, "a " * k, "s", k) for k in (1, 5, 9)] + [(None, "b " * k, "t", k) for k in range(1, 60)] + [(None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int")
    got, again = ([tuple(r) for r in mixing.mixed_rows(docs).collect()] for _ in "ab")
    assert sorted(got, key=str) == sorted(again, key=str) and mixing.mixed_rows(docs).columns == docs.columns
    want = {(r.source, r["size"]): r.copies for r in mixing.mix(docs).collect()}
    for i, text, source, k in rows:
        assert got.count((i, text, source, k)) == want[source, k]


def test_shards_are_written_by_row(spark, tmp_path):
    from codexa.llm import sharding

    docs = spark.createDataFrame([(1, "x" * 1200, "mine")] * 3 + [(None, "y" * 900, "mine")] * 3 + [(i, "z" * 100, None) for i in range(2, 30)], "doc_id long, text string, shard string")
    column = sharding.write_shards(docs, str(tmp_path / "out"), limit=1300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert column == "shard_" and sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    sizes = {r[column]: (r.n, r.b) for r in back.groupBy(column).agg({"*": "count", "text": "count"}).toDF(column, "n", "b").collect()}
    bytes_of = {}
    for r in back.collect():
        assert r[column].startswith("b") and isinstance(r[column], str)
        bytes_of[r[column]] = bytes_of.get(r[column], 0) + len(r.text)
    assert all(b <= 1300 for b in bytes_of.values()) and len(sizes) == len(bytes_of)
    assert len(list((tmp_path / "out").glob("*/*.parquet"))) == len(sizes)


def test_stages_keep_the_columns_of_their_input(spark, tmp_path):
    rows = [(i, f"{'vile' if i % 4 == 0 else 'kind'} {'junk ' * 9 if i % 3 == 0 else ''}words n{i} a{i * 7} b{i * 3}", "en", f"s{i % 2}", 1, 0.123, "t", 5) for i in range(80)] + [(None, None, None, None, 1, 0.123, "t", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_score double, toxicity string, _row int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert good.schema == docs.schema and {r.doc_id for r in good.where("doc_id is not null").collect()} == {i for i in range(80) if i % 3}
    assert {r.quality_score for r in good.collect()} == {0.123}
    clean = corpus_pipeline.not_toxic(spark, docs, str(tmp_path))
    assert clean.schema == docs.schema and {r.doc_id for r in clean.collect()} == {i for i in range(80) if i % 4} | {None}
    assert corpus_pipeline.mixture(spark, docs, str(tmp_path)).schema == docs.schema
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {i for i in range(80) if i % 3 and i % 4}
    got = [r for r in out.collect() if r.doc_id is not None]
    assert {r.doc_id for r in got} <= kept and "sequence_id" in out.columns and len(got) > len(kept) / 4
