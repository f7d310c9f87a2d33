import corpus_pipeline
from fixtures import ALNUM_WORD, UP, clashing, documents, spark_docs
from test_words_and_dedup import expected_components, expected_hits, windows_of

from helixspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_over_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        was, now = [tuple(r) for r in before.collect()], [tuple(r) for r in after.collect()]
        if name == "mixture":
            assert after.columns == [*columns, "mix_epoch"] and {r[:-1] for r in now} <= set(was)
        else:
            assert after.columns == columns
        if name == "language_id":
            assert sorted(now) == sorted(r for r in was if any(c.isalpha() for c in r[1] or ""))
        if name == "line_dedup":
            assert sorted(r[0] for r in was) == sorted(r[0] for r in now) and all(r[4] == len(r[1]) for r in now)
        if name == "minhash_dedup":
            assert {r[0] for r in now} == {c for _, _, c in expected_components(was, 5)} and set(now) <= set(was)
        if name == "decontamination":
            windows = windows_of(benchmark, 13)
            hits = {r[0]: expected_hits(r[1], windows) for r in was}
            assert sorted(now) == sorted(r for r in was if not (hits[r[0]][1] and 20 * hits[r[0]][1] >= hits[r[0]][0]))
        before = after


def test_stages_take_awkward_rows_and_empty_tables(spark):
    for rows in (documents(), []):
        docs = clashing(spark_docs(spark, rows))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert [c for c in out.columns if c != "mix_epoch"] == docs.columns, name
            assert out.count() >= (1 if rows else 0)


def test_words_of_the_contract():
    assert ALNUM_WORD.findall("A-b_É 9".translate(UP)) == ["a", "b", "É", "9"]


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
