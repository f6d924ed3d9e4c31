import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.helpers import components, docs, shingle_set, texts


def test_stages_keep_columns_and_order(spark):
    assert [name for name, _ in P.STAGES] == ["language", "toxicity", "near_copies", "packing"]
    d = docs(spark)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
    left = sorted(r.doc_id for r in out.collect())
    sets = {i: shingle_set(t, P.WORDS) for i, t in enumerate(texts())}
    assert left == sorted(i for i, c in components(sets, P.PERCENT).items() if c == i)


def test_empty(spark):
    for _, stage in P.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0


def test_run(spark):
    rows = P.run(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.6 * n < len({r.doc_id for r in rows}) < n
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_copies_with_equal_ids_stay_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, text, "z"), (3, None, "n")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in P.one_of_near_copies(spark, df, SF).collect()) == [1, 3]


def test_rows_with_equal_ids_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(7, text, 1), (9, text + " tail", 2), (9, "other text", 3), (None, text, 4), (None, None, 5)], "doc_id long, text string, kept_id int")
    kept = P.one_of_near_copies(spark, df, SF)
    assert kept.columns == df.columns and sorted(r.kept_id for r in kept.collect()) == [1, 3, 5]


def test_columns_of_any_name(spark):
    names = ["key", "th", "row", "cid", "comp", "n", "a b", "x.y", "head"]
    df = spark.createDataFrame([(1, "some text of seven words is here", *range(9)), (2, "some text of seven words is here", *range(9))], ["doc_id", "text", *names])
    rows = P.one_of_near_copies(spark, df, SF).collect()
    assert [tuple(r) for r in rows] == [(1, "some text of seven words is here", *range(9))]
