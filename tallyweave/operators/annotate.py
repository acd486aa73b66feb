"""Annotators as DataFrame functions: any callable that answers a batch of texts, run in Arrow batches where the rows are."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.votes import drift, parse_answers, set_hash
from tallyweave.session import cut_lineage, exists

#: Answers of a batch of texts, in order: raw JSON strings. Raising an error fails the batch after its retries.
Answer = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Annotator:
    """A model with a prompt. ``connect`` is called once per task, so that connections are made on the executor."""

    model_id: str
    prompt_id: str
    connect: Callable[[], Answer]
    retries: int = 3
    first_wait: float = 0.5

    @property
    def source_id(self) -> str:
        return f"{self.model_id}__{self.prompt_id}"


def annotate(df: DataFrame, annotator: Annotator, id_col: str, text_col: str) -> DataFrame:
    """Per row: ids, raw answer, parsed answer, label and error. A batch that keeps failing gives error rows, not a failed job;
    null texts are sent as empty ones. Rows already in the store should be taken out before (see votes.pending)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = annotator.connect()
        for b in batches:
            raw, error = None, None
            for k in range(annotator.retries):
                try:
                    raw = answer(b[text_col].fillna("").tolist())
                    error = None
                    break
                except Exception as e:  # noqa: BLE001  any failure of a remote annotator is a row's error
                    error = f"{type(e).__name__}: {e}"[:500]
                    if k + 1 < annotator.retries:
                        time.sleep(annotator.first_wait * 2**k * (1 + random.random()))
            yield pd.DataFrame({id_col: b[id_col], "raw_response": raw if raw is not None else [None] * len(b), "error": [error] * len(b)})

    got = df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, raw_response string, error string")
    parsed = parse_answers(got, "raw_response")
    return parsed.select(id_col, F.lit(annotator.source_id).alias("source_id"), F.lit(annotator.model_id).alias("model_id"), F.lit(annotator.prompt_id).alias("prompt_id"), "raw_response", "answer", "label", F.coalesce("error", "parse_error").alias("error"))


def run(records: DataFrame, annotators: list[Annotator], store: str, id_col: str = "EIN2", text_col: str = "text", audits: str | None = None, canaries: DataFrame | None = None) -> DataFrame:
    """Annotates every record that the store has no good answer for, annotator by annotator, and returns what was added.

    Answers are appended to the store as each annotator ends, so a run that goes on after a failure asks for nothing twice; failed answers are stored
    with their error and asked for again next time. With canaries, records labelled on every run, one audit row per
    annotator tells how their labels changed since its first audit of the same set. There are as many annotators as models x prompts.
    """
    from tallyweave.sources import io

    spark = records.sparkSession
    added = None
    for a in annotators:
        todo = records.select(id_col, text_col)
        if exists(spark, store):
            done = spark.read.parquet(store).filter((F.col("source_id") == a.source_id) & F.col("error").isNull()).select(F.col("EIN2").alias(id_col)).distinct()
            todo = todo.join(done, id_col, "left_anti")
        got = cut_lineage(_stored(annotate(todo, a, id_col, text_col).join(todo, id_col), id_col, text_col))
        io.append_store(got, store)
        added = got if added is None else added.unionByName(got)
        if canaries is not None and audits is not None:
            audit(canaries, a, audits, id_col, text_col).write.mode("append").json(f"{audits}/log")
    return added if added is not None else spark.createDataFrame([], io.STORE)


def _stored(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Answers in the columns of the store."""
    a = F.col("answer")
    ok = F.col("error").isNull()
    return answers.select(
        F.col(id_col).alias("EIN2"), F.col(text_col).alias("text"), "source_id", F.lit("llm_prompt").alias("source_type"), F.col("label").cast("double").alias("label"), F.when(ok, a["confidence"]).alias("confidence"), "model_id", "prompt_id",
        F.current_timestamp().alias("run_timestamp"), F.when(ok, a["reason"]).alias("reason"), F.when(ok, F.to_json(a["domains_present"])).alias("domains_present"), F.when(ok, F.to_json(a["evidence_spans"])).alias("evidence_spans"),
        F.when(ok, a["boundary_notes"]).alias("boundary_notes"), F.when(ok, a["binary_label"]).alias("binary_label"), "raw_response", "error",
    )


AUDIT = "source_id string, set_hash string, n_ids long, n_common long, n_changed long, kappa double, alpha double, first boolean"


def audit(canaries: DataFrame, annotator: Annotator, path: str, id_col: str = "EIN2", text_col: str = "text") -> DataFrame:
    """Labels the canaries anew, keeps the labels under ``path`` and returns one row: the change against the first audit of the same annotator and set."""
    spark = canaries.sparkSession
    labels = cut_lineage(annotate(canaries, annotator, id_col, text_col).select(id_col, "label"))
    h = set_hash(labels, id_col).first()
    base = f"{path}/{annotator.source_id}/{h['set_hash']}"
    first = not exists(spark, f"{base}/_SUCCESS")
    if first:
        labels.write.mode("overwrite").parquet(base)
    found = drift(spark.read.parquet(base), labels, id_col, "label")
    return found.select(F.lit(annotator.source_id).alias("source_id"), F.lit(h["set_hash"]).alias("set_hash"), F.lit(h["n_ids"]).alias("n_ids"), "n_common", "n_changed", "kappa", "alpha", F.lit(first).alias("first"))
