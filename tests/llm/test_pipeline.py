import duckdb

import corpus_pipeline as C


def test_stages_against_their_definitions(spark, sf_dir):
    """Each stage on its own input, against the operators' brute-force versions."""
    import sentencepiece

    from logfold.llm import oracles, pieces

    from .test_decontaminate import brute as hits
    from .test_lines import brute as lines
    from .test_simhash import jaccard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [len(s) for s in C.STAGES] == [2] * 5
    kept = C.quality_rules(spark, docs, sf_dir)
    assert kept.columns == columns
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in kept.collect()}
    judged = duckdb.connect()
    judged.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    kept_ids = {r[0] for r in judged.execute(f"select doc_id from ({oracles.op5()}) where kept").fetchall()}
    assert all(before[i] == r for i, r in after.items()) and set(after) == kept_ids and 0 < len(after) < len(before)

    out = C.line_dedup(spark, kept, sf_dir)
    want = {i: t for i, t, n, d in lines([(r.doc_id, r.text) for r in after.values()], 200) if d == 0 or d < n}
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    out = C.near_dedup(spark, out, sf_dir)
    stay = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and all(got[i] == r for i, r in stay.items())
    # One of each component of pairs at 0.8 or more stays: the least.
    least = {i: i for i in got}
    for i in sorted(got):
        for j in got:
            if i < j and jaccard(got[i].text, got[j].text) >= 0.8:
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    assert set(stay) == set(least.values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = C.benchmark_decontamination(spark, out, sf_dir)
    dirty = {i for i, _, n, _, _ in hits([(i, r.text) for i, r in stay.items()], items, 10) if n}
    assert out.columns == columns and {r.doc_id for r in out.collect()} == set(stay) - dirty

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    last = {r.doc_id: list(r.ids) for r in C.encoding(spark, out, sf_dir).collect()}
    assert last == {i: model.encode(stay[i].text) for i in set(stay) - dirty}
    assert {r.doc_id: list(r.ids) for r in C.run(spark, sf_dir).collect()} == last


def test_empty_and_odd_inputs(spark, sf_dir, odd, empty):
    for docs in (empty, odd):
        for _, stage in C.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.count()


def test_odd_rows_keep_their_columns_and_values(spark, sf_dir, odd):
    """All but the last stage return the columns of their input; what stays is as it came, but for the deleted lines."""
    docs, others = odd, [c for c in odd.columns if c not in ("text", "n_chars")]
    plain = lambda df, names: sorted(str([r[c] for c in names]) for r in df.collect())
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema["map"].dataType == docs.schema["map"].dataType, name
        assert set(plain(out, others)) <= set(plain(docs, others)), name
        docs = out
    assert set(plain(docs, ["doc_id"])) <= set(plain(odd, ["doc_id"]))
