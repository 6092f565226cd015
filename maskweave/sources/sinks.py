"""Writing results: redacted corpora, detection lines, scores per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.operators.audit import split_clean
from maskweave.session import scratch, staged


def write_corpus(
    audited: DataFrame,
    clean_path: str,
    quarantine_path: str,
    key: list[str],
    columns: list[str],
    mode: str = "append",
):
    """Rows that passed the audit to one table, the others' keys and reasons to another.

    Only what is named is written: ``key`` and ``columns`` of clean rows, ``key`` and ``reason`` of
    quarantined ones, whose texts still show protected terms.  Originals, spans and vaults cannot
    be named.  The checked rows are written once, split by reason, so the audit runs once.
    """
    private = sorted({"text", "spans", "vault", "cuts"} & set([*key, *columns]))
    if private:
        raise ValueError(f"not for a clean table: {', '.join(private)}")
    names = list(dict.fromkeys([*key, *columns]))
    ok = F.col("reason").isNull()
    rest = [c for c in names if c not in key]
    # Columns of held rows are emptied before anything is written.
    with scratch(audited.sparkSession):
        checked = staged(
            audited.select(*key, *[F.when(ok, F.col(c)).alias(c) for c in rest], "reason"), "checked"
        )
        split_clean(checked)[0].write.mode(mode).parquet(clean_path)
        held = checked.where(~ok).select(*key, "reason")
        held.write.mode(mode).partitionBy("reason").parquet(quarantine_path)


def write_entities(detected: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines of {id, entities: [{start, end, label, score, source}]}, in the id's own type;
    a row with an ``error`` (a line that could not be read) gives {id, error}."""
    fields = ("start", "end", "label", "score", "source")
    entities = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in fields]))
    error = F.col("error") if "error" in detected.columns else F.lit(None).cast("string")
    rows = detected.select(
        "id", F.when(error.isNull(), entities).alias("entities"), error.alias("error")
    )
    # Null fields are left out of a JSON line.
    rows.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_task_results(results: DataFrame, path: str, task: str = "task_name") -> None:
    """Replace only the tasks present in ``results``; the others' results stay."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(task)
        .parquet(path)
    )
