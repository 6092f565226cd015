import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from maskweave.llm import bpe, queries
from maskweave.llm import token_rollup as T
from maskweave.llm.common import read
from tests.llm.conftest import SAMPLE, needs_data

COUNTED = "source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint"


@pytest.fixture
def ledger(spark, tmp_path):
    return T.Ledger(spark, str(tmp_path / "ledger"))


def totals(ledger):
    return {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}


def test_changes_add_up(spark, ledger):
    first = spark.createDataFrame([("a", "en", "v1", 10, 50), ("a", "en", "v1", 5, 20), (None, None, "v1", None, 0)], COUNTED)
    assert totals(ledger) == {}
    ledger.commit(1, T.inserts(first))
    assert totals(ledger) == {("a", "en", "v1"): (2, 15, 70), (None, None, "v1"): (1, 0, 0)}
    old = spark.createDataFrame([("a", "en", "v1", 5, 20)], COUNTED)
    new = spark.createDataFrame([("a", "en", "v2", 4, 20)], COUNTED)
    ledger.commit(2, T.revisions(old, new))
    ledger.commit(3, T.deletes(first.where("source IS NULL")))
    want = {("a", "en", "v1"): (1, 10, 50), ("a", "en", "v2"): (1, 4, 20)}
    assert totals(ledger) == want
    # Commits are idempotent, before and after folding; a retry may also bring other rows.
    ledger.commit(2, T.revisions(old, new))
    assert totals(ledger) == want
    ledger.compact()
    ledger.compact()
    ledger.commit(3, T.deletes(first.where("source IS NULL")))
    assert totals(ledger) == want
    ledger.commit(4, T.inserts(new))
    ledger.commit(4, T.inserts(new.limit(0)))
    assert totals(ledger) == want
    ledger.commit(5, T.deletes(new))
    ledger.commit(6, T.deletes(spark.createDataFrame([("a", "en", "v1", 10, 50)], COUNTED)))
    assert totals(ledger) == {}
    ledger.compact()
    ledger.commit(5, T.deletes(new))
    assert totals(ledger) == {}


def test_a_folded_batch_takes_no_other_sums(spark, ledger):
    def rows(n):
        return T.inserts(spark.createDataFrame([("a", None, "v1", n, 1)], COUNTED))

    ledger.commit(1, rows(10))
    ledger.compact()
    ledger.commit(1, rows(10))
    with pytest.raises(ValueError, match="other sums"):
        ledger.commit(1, rows(99))
    assert totals(ledger) == {("a", None, "v1"): (1, 10, 1)}
    ledger.commit_all(rows(10).withColumn("batch", F.lit(1)).unionByName(rows(5).withColumn("batch", F.lit(2))), [1, 2])
    assert totals(ledger) == {("a", None, "v1"): (2, 15, 2)}


def test_several_batches_at_once(spark, ledger):
    rows = spark.createDataFrame([("a", "en", "v1", n, n) for n in range(20)], COUNTED)
    changes = T.inserts(rows).withColumn("batch", F.pmod("n_tokens", F.lit(3)).cast("bigint"))
    ledger.commit_all(changes, [0, 1, 2, 9])
    assert totals(ledger) == {("a", "en", "v1"): (20, 190, 190)}
    assert ledger.batch(9).where("n_docs <> 0").count() == 0


def test_awkward_rows(spark, awkward, nothing, ledger):
    ledger.commit_all(queries.token_changes(spark, nothing), [1, 2, 3, 4, 5, 6])
    assert totals(ledger) == {}
    ledger.commit_all(queries.token_changes(spark, awkward), [1, 2, 3, 4, 5, 6])
    assert sum(v[0] for v in totals(ledger).values()) == awkward.count()


@needs_data
def test_query_against_a_plain_count(spark):
    encoders = {}
    for name in (queries.VOCABULARY, queries.NEW_VOCABULARY):
        with open(public_tokenizers.path(name), "rb") as f:
            encoders[name] = tiktoken.Encoding(
                name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={}
            )
    want = {}
    for r in read(spark, SAMPLE, "documents").collect():
        if r["doc_id"] % 20 == 0:
            continue
        name = queries.NEW_VOCABULARY if r["lang"] == "fr" else queries.VOCABULARY
        t = want.setdefault((r["source"], r["lang"], name), [0, 0, 0])
        t[0] += 1
        t[1] += len(encoders[name].encode_ordinary(r["text"] or ""))
        t[2] += len(r["text"] or "")
    got = {tuple(r)[:3]: list(r)[3:] for r in queries.op5_token_counts(spark, SAMPLE).collect()}
    assert got == want
