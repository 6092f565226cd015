import pytest
from pyspark.sql import functions as F

from maskweave.operators import vault as V

SEG = "conv_id bigint, seg_no bigint, text string"


def spans(spark, rows):
    return spark.createDataFrame(
        rows, "conv_id bigint, seg_no bigint, start bigint, end bigint, label string, value string"
    )


def test_numbers_follow_first_appearance_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "SEGMENTS_PER_BLOCK", 2)
    rows = [(1, s, 0, 1, "org", f"v{s}") for s in range(7)]
    rows += [(1, 6, 3, 4, "ORG", "v0"), (1, 3, 5, 6, "email", "v1"), (2, 0, 0, 1, "Org", "v5")]
    got = {(r.conv_id, r.real): r.placeholder for r in V.assign_placeholders(spans(spark, rows)).collect()}
    assert got == {**{(1, f"v{i}"): f"<<ORG_{i + 1}>>" for i in range(7)}, (2, "v5"): "<<ORG_1>>"}


def test_spelling_makes_its_own_placeholder(spark):
    rows = [(1, 0, 0, 9, "ORG", "Cartalian"), (1, 0, 10, 19, "ORG", "cartalian")]
    segs = spark.createDataFrame([(1, 0, "Cartalian cartalian")], SEG)
    red, _ = V.redact_conversations(segs, spans(spark, rows))
    assert red.first().redacted == "<<ORG_1>> <<ORG_2>>"


@pytest.fixture
def vault(spark):
    rows = [
        (1, "a@example.com", "EMAIL_1"), (1, "Cartalian", "ORG_1"), (2, "<<EMAIL_1>>", "ORG_1"),
        (2, "x@example.com", "EMAIL_1"),
    ]
    return spark.createDataFrame(rows, "conv_id bigint, real string, inner string")


def test_restore_is_tolerant_single_pass_and_isolated(spark, vault):
    texts = [
        (1, 0, "Write to << email_1 >> at <<ORG_1>>; unknown <<ORG_9>> stays."),
        (2, 0, "<<ORG_1>>"),
        (3, 0, "<<ORG_1>> / <<EMAIL_1>>"),
        (1, 1, "<<<EMAIL_1>>>"),
        (1, 2, "no << token"),
    ]
    out = V.restore_by_join(spark.createDataFrame(texts, SEG), vault).collect()
    assert {(r.conv_id, r.seg_no): r.restored for r in out} == {
        (1, 0): "Write to a@example.com at Cartalian; unknown <<ORG_9>> stays.",
        (2, 0): "<<EMAIL_1>>",
        (3, 0): "<<ORG_1>> / <<EMAIL_1>>",
        (1, 1): "<a@example.com>",
        (1, 2): "no << token",
    }


def test_row_vault_matches_conversation_vault(spark):
    from maskweave.functions.spans import SPANS_TYPE

    found = [(0, 1, "org", "regex", 0.0, "a"), (2, 3, "ORG", "regex", 0.0, "b"), (4, 5, "x", "regex", 0.0, "a")]
    df = spark.createDataFrame([("a b a", found)], f"text string, spans {SPANS_TYPE}")
    assert V.redact_rows(df).first().redacted == "<<ORG_1>> <<ORG_2>> <<ORG_1>>"


def test_seal(spark, vault):
    key = b"k" * 32
    sealed = V.seal(vault, "real", key, ["conv_id", "inner"])
    sealed = sealed.persist()
    assert sealed.select("real").distinct().count() == 4
    opened = V.unseal(sealed, "real", key, ["conv_id", "inner"])
    assert {r.real for r in opened.collect()} == {r.real for r in vault.collect()}
    for bad in (
        V.unseal(sealed, "real", b"z" * 32, ["conv_id", "inner"], strict=False),
        V.unseal(sealed.withColumn("conv_id", F.col("conv_id") + 1), "real", key, ["conv_id", "inner"], strict=False),
        V.unseal(sealed, "real", key, ["conv_id", "inner"], version="v2", strict=False),
    ):
        assert bad.where(F.col("real").isNotNull()).count() == 0
    with pytest.raises(Exception):
        V.unseal(sealed, "real", b"z" * 32, ["conv_id", "inner"]).collect()
    assert V.unseal(vault, "real", key, ["conv_id"]).count() == 4
    sealed.unpersist()
