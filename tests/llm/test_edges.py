"""Rows at the borders of what numbers and samples hold: one test for each loss that was found."""

import numpy as np
import pytest


def test_long_texts_train_the_dictionary(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from stanchion.llm import token_store as T

    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 4_500))) for i in range(40)], "doc_id long, text string").repartition(4)
    out = T.new_store(spark)
    T.write_tokens(docs, out, tokenizers.path("byte_bpe_50k.json"))
    assert 0 < len(spark.read.parquet(f"{out}/dictionary").first().dictionary) <= T.DICT_BYTES
    assert T.read_tokens(spark, out).count() == 40


def test_distances_that_overflow(spark):
    from stanchion.llm.vector_search import distances, search

    rows = [(0, [1e200, 0.0]), (1, [-1e200, 0.0]), (2, [1e200, 3e200]), (3, [1e-200, 0.0]), (4, [1.7e308, 1.7e308]), (5, [-1.7e308, -1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r["rank"], r.score) for r in search(df, df).collect()}
    assert len(got) == 30
    assert got[0, 3] == (1, 1e200) and got[0, 1][1] == pytest.approx(2e200, rel=1e-15) and got[0, 2] == (3, 3e200)
    assert got[4, 5] == (5, np.inf)
    x = np.random.default_rng(2).standard_normal((50, 7))
    assert (distances(x, x[0]) == np.sqrt(((x - x[0]) ** 2).sum(1))).all()
    assert distances(x * 1e-200, x[0] * 1e-200) == pytest.approx(1e-200 * distances(x, x[0]), rel=1e-14)


def test_a_null_id_is_not_the_largest_one(spark):
    from stanchion.llm.substring_dedup import substring_dedup

    text = " ".join(f"w{i}" for i in range(60))
    one = spark.createDataFrame([(2**63 - 1, text), (None, text), (None, text)], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup(one).collect()} == {2**63 - 1: (0, text), None: (60, "")}
    two = spark.createDataFrame([(None, text), (None, text + " " + text)], "doc_id long, text string")
    # the rows of a null id are one document, so only what starts later in it goes
    assert sorted(r.n_removed for r in substring_dedup(two).collect()) == [0, 60]


def test_score_keeps_a_column_of_its_name(spark, tmp_path):
    import corpus_pipeline as P
    from stanchion.llm.toxicity import score

    rows = [(i, "you stupid idiot go away" if i % 3 == 0 else "a calm text about the weather", "en", "s", 9, 0.25, 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity_score double, _toxicity_score long")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = P.toxicity(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(tuple(r) for r in left.collect()) == [r for r in rows if r[0] % 3]
    with pytest.raises(ValueError):
        score(docs, None)
