"""Each stage of the pipeline against plain Python, on the smallest tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from noticeloom.llm.bpe import word_bpe
from noticeloom.llm.common import table
from noticeloom.llm.surrogates import KEY, replaced
from noticeloom.llm.toxicity import train_toxicity
from tests.llm.test_neardup import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_toxic_go(spark, stages):
    docs = table(spark, SF, "documents")
    scored = train_toxicity(docs, table(spark, SF, "labels")).score(docs).collect()
    assert rows(stages[0]) == sorted((tuple(r[:5]) for r in scored if r.score < 0.5), key=str)


def test_one_of_each_group_stays(stages):
    before = rows(stages[0])
    kept = {i for i, _, _, k in plain_components([(r[0], r[1]) for r in before], 4, 5) if k}
    assert rows(stages[1]) == [r for r in before if r[0] in kept]


def test_surrogates(stages):
    want = [(i, t := replaced(text, {}, KEY)[0], lang, s, len(t)) for i, text, lang, s, _ in rows(stages[1])]
    assert rows(stages[2]) == sorted(want, key=str)


def test_mix(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(after) <= set(before) and all(after.count(r) <= 2 for r in after)
    words = lambda rs: sum(len(r[1].encode().split()) for r in rs)
    assert abs(words(after) - 1.5 * words(before)) < 0.1 * words(before)


def test_encoding(stages):
    bpe = word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r[0], next(bpe.encode_batch([r[1]]))[0]) for r in rows(stages[3]))
    assert sorted((r.doc_id, r.n_tokens) for r in stages[4].collect()) == want


def test_run(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_rows_and_columns(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns of clashing names, and no rows."""
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 1), (2, "", "en", None, 0), (3, "ü " * 50_000, None, "s", 9), (4, "x y z", "de", "t", 5), (4, "x y z", "de", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.selectExpr("*", "1 AS toxicity_score", "2 AS row", "3 AS copies", "4 AS row_mark", "5 AS skey", "6 AS features")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, SF)
        got = out.collect()
        assert stage(spark, more.limit(0), SF).count() == 0
        if name == "bpe":
            assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[1] == (1, 0)
            continue
        assert out.columns == more.columns
        assert all((r.toxicity_score, r.row, r.copies, r.row_mark, r.skey, r.features) == (1, 2, 3, 4, 5, 6) for r in got)
        if name in ("toxicity", "near_duplicates"):
            assert len(got) == 6
        if name == "personal_data":
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)


def test_copies_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    rows = [(None, text), (None, text), (5, near), (7, "other words stand here alone now"), (None, None), (None, None), (None, ""), (3, near), (3, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert left == sorted([(None, text), (7, "other words stand here alone now"), (None, None), (None, None), (None, "")], key=str)
