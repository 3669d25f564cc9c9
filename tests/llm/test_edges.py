"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from octavo.llm import chunk_dedup, decontaminate, jaccard_join, line_dedup, lm_score, packing, pii, quality, stages, url_filter, vector_dedup

from .data import documents, empty, texts

N = len(texts()) + 1


def bench(spark):
    return spark.createDataFrame([(0, texts()[12]), (1, None), (2, "too short"), (None, texts()[13])], "item_id bigint, text string")


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contained(d, bench(s)),
    "decontaminate.clean": lambda s, d: decontaminate.clean(d, bench(s)),
    "chunks": lambda s, d: chunk_dedup.dedup_chunks(d),
    "packing": lambda s, d: packing.pack(d),
    "jaccard": lambda s, d: jaccard_join.components(d),
    "jaccard.representatives": lambda s, d: jaccard_join.representatives(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "pii": lambda s, d: pii.find(d, field=FIELD),
    "lm": lambda s, d: lm_score.scores(d),
    "quality": lambda s, d: quality.score(d, quality.train(d, labels(s, [(3, 1, 0), (4, 0, 0), (5, None, 0), (6, 1, 0), (None, 1, 1)]))),
}
FIELD = pii.Field.fit(pii.sentences(20), rounds=2)
ONE_EACH = ("chunks", "jaccard", "lines", "pii", "lm", "quality")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    rows = OPERATORS[name](spark, documents(spark)).collect()
    if name in ONE_EACH:
        assert len(rows) == N
        ids = [r.doc_id for r in rows]
        assert ids.count(20) == 2 and len({str(r) for r in rows if r.doc_id == 20}) <= 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_in_every_column(spark, name):
    df = documents(spark, [(0, "some words stand here " * 9), (1, None), (2, "other words " * 30)])
    nulls = spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema)
    rows = OPERATORS[name](spark, df.unionByName(nulls)).collect()
    if name in ONE_EACH:
        assert len(rows) == 5


@pytest.mark.parametrize("name", ["chunks", "lines", "jaccard.representatives", "decontaminate.clean"])
def test_other_columns_stay(spark, name):
    df = documents(spark)
    out = OPERATORS[name](spark, df)
    assert out.columns[:len(df.columns)] == df.columns
    assert {r.h for r in out.collect()} == {"h"}


def test_pages_and_vectors(spark):
    schema = "page_id bigint, url string, host string, key string, a int"
    rows = [(1, None, "h", "k", 1), (2, "", "h", "k", 1), (3, "no scheme", "h", "k", 1), (3, "no scheme", "h", "k", 1), (4, "http://" + "a." * 3000 + "com/x", "h", "k", 1)]
    listed = spark.createDataFrame([("b.com",), (None,), ("",)], "key string")
    for df, n in ((spark.createDataFrame(rows, schema), 5), (spark.createDataFrame([], schema), 0)):
        assert url_filter.judge(df, listed).count() == n
    schema = "vec_id bigint, embedding array<float>, id string, u string"
    rows = [(1, None, "", ""), (2, [], "", ""), (3, [0.0, 0.0], "", ""), (4, [None, 1.0], "", ""), (5, [float("nan"), 1.0], "", ""), (6, [1.0, 2.0], "", ""),
            (6, [1.0, 2.0], "", ""), (7, [2.0, 4.0], "", ""), (8, [1.0, 2.0, 0.0], "", ""), (None, [1.0, 2.0], "", "")]
    got = {(r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 2, 6), (7, 2, 6), (8, 0, 8), (None, 0, None)} == got
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_stages_return_the_columns(spark, tmp_path):
    labels(spark, [(3, 1, 0), (4, 1, 0)]).write.parquet(f"file://{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    for f in (stages.keep_good, stages.drop_lines, stages.drop_near_copies, stages.drop_contaminated):
        assert f(spark, docs, f"file://{tmp_path}").columns == docs.columns
    assert stages.pack(spark, docs, "").count() > 0


def test_scratch_tables_can_be_cleared(spark):
    import os

    from octavo.llm import shared

    df = shared.materialize(spark.range(3), "numbers")
    folder = shared.scratch(spark).removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(folder)
    shared.clear_scratch(spark)
    assert not os.path.exists(folder)


LONG = [(0, " " * 2_000_000), (1, "x" * 2_000_000), (2, "7" * 2_000_000), (3, "0" * 5000 + ".1.1.1"), (4, "ab " * 400_000), (5, "\n" * 500_000), (6, "a b c d e f g " * 60_000)]


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, name):
    rows = OPERATORS[name](spark, documents(spark, LONG)).collect()
    if name in ONE_EACH:
        assert sorted(r.doc_id for r in rows) == list(range(len(LONG)))
    if name == "packing":
        assert {r.doc_id: r.doc_tokens for r in rows}[0] == 2_000_001


STAGES = {"good": stages.keep_good, "lines": stages.drop_lines, "copies": stages.drop_near_copies, "contaminated": stages.drop_contaminated}


def put(spark, tmp_path, docs, marks, items):
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_awkward_rows(spark, tmp_path, name):
    """Nulls in every column, empty and long texts, repeated rows and columns that the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(texts()[:30])] + LONG[3:5]
    docs = documents(spark, [(k, t) for k, (_, t) in enumerate(rows)])
    nulls = spark.createDataFrame([tuple([None] * len(docs.columns))] * 2, docs.schema)
    folder = put(spark, tmp_path, docs.unionByName(nulls), [(k, 1, 0) for k in range(25)], [(0, "never seen in any of these"), (1, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[name](spark, docs, folder)
    assert out.schema.names == docs.schema.names
    got = out.collect()
    if name != "copies":
        assert len(got) == docs.count() or name == "lines"
    assert {r.doc_id for r in got} >= {None, 0, 1, 2} and [r.doc_id for r in got].count(20) in (0, 2)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_empty_tables(spark, tmp_path, name):
    folder = put(spark, tmp_path, empty(spark), [], [])
    out = STAGES[name](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert out.count() == 0 and out.columns == empty(spark).columns


def test_pipeline_on_empty_tables_and_without_labels(spark, tmp_path):
    import corpus_pipeline

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert corpus_pipeline.run(spark, put(spark, tmp_path / "a", empty(spark), [], [])).count() == 0
    docs = documents(spark, [(k, t) for k, t in enumerate(texts()[12:18])] + [(90, None), (91, "")])
    got = corpus_pipeline.run(spark, put(spark, tmp_path / "b", docs, [], []))
    assert {r.doc_id for r in got.collect()} >= {90, 91}


def test_scratch_of_a_scope_goes(spark):
    import os

    from octavo.llm import shared

    folder = shared.scratch(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with shared.scratch_scope(spark):
        assert shared.materialize(spark.range(3), "numbers").count() == 3
    assert set(os.listdir(folder)) - before == set()
