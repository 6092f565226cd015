import corpus_pipeline as P
from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskweave.llm.common import read
from tests.llm.conftest import SAMPLE, needs_data, prose


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {
        k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit() or k == "pipeline"
    }


@needs_data
def test_stages(spark, make_docs):
    bench = read(spark, SAMPLE, "benchmark").orderBy("item_id").first()["text"]
    rows = [(n, prose(n, 90), "en", "s") for n in range(40)]
    rows += [(50, rows[0][1], "en", "s"), (50, rows[0][1], "en", "s"), (51, "12 34 !!", "en", "s"), (52, None, "en", "s")]
    rows += [(53, prose(99, 30) + " " + bench + " " + prose(98, 30), "en", "s")]
    rows += [(54, prose(97, 60) + " write to someone@mail.example.com now", "en", "s")]
    docs = make_docs(rows)
    columns = docs.columns
    sizes = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SAMPLE)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    got = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(got) == [*range(40), 54]
    assert sizes[0] == len(rows) - 2 and sizes[1:] == [42, 41, 41, 41]
    assert got[54]["text"].endswith("write to [EMAIL] now") and got[54]["n_chars"] == len(got[54]["text"])
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) > 0 for r in got.values())


@needs_data
def test_run(spark, nothing):
    out = P.run(spark, SAMPLE)
    docs = read(spark, SAMPLE, "documents")
    assert out.columns[: len(docs.columns)] == docs.columns
    assert 0.6 * docs.count() < out.count() < docs.count()
    assert out.where(F.col("text").contains("@mail")).count() == 0


def test_empty_table(spark, nothing, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = nothing
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
