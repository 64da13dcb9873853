"""A training-data pipeline over ``documents``: quality, near copies, repeated passages, benchmark leaks, pieces.

Each stage takes the session, the rows its predecessor kept and the folder of the tables, and returns a DataFrame;
its rows are written as Parquet before the next stage reads them. All but the last return the columns of documents.
As a stage's rows are written by then, the next one begins by deleting the tables that it wrote for itself; ``run``
deletes the last one's. What belongs together is told by thread and folder of tables.

1. quality classifier: rows that are predicted to be bad go.
2. SimHash near-dedup: of each group of near copies the row with the least id stays.
3. substring dedup: words covered by a repeated passage are cut out; a text of which nothing is left goes.
4. benchmark decontamination: rows of which a twentieth or more lies in benchmark passages go.
5. SentencePiece encoding: every text that is left, as ids, with the decoded text's agreement.

No stage has SQL: the first learns its model, the others build on it. Tests compare each with a brute-force form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import debruijn, decontaminate, lm_scoring, quality, queries, sentencepiece_scan, simhash
from tallyhouse.sources.workspace import made, materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.7
#: Scratch folders of the latest stage, for each thread and folder of tables.
_scratch: dict[tuple[int, str], list[str]] = {}


def clear(spark: SparkSession, sf_dir: str) -> None:
    """Delete what the latest stage over ``sf_dir`` in this thread wrote for itself."""
    release(spark, _scratch.pop((get_ident(), sf_dir), []))


def clearing(stage: Stage) -> Stage:
    """The stage, which first deletes what the stage before it wrote for itself. Pipelines over other tables or in other
    threads keep theirs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, sf_dir)
        before = set(made())
        rows = stage(spark, docs, sf_dir)
        _scratch[get_ident(), sf_dir] = [f for f in made() if f not in before]
        return rows

    return run_stage


@clearing
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows scored 0.7 or more. A row carries its own score, so rows with a null or repeated id are judged by
    their own text."""
    part = lm_scoring.fold("doc_id", 4)
    labels = queries.table(spark, sf_dir, "labels")
    scored = quality.scores(docs, labels, part < 2, part == 3, keep=COLUMNS)
    return scored.where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


@clearing
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the one with its least id (rows with that id: the first by text)."""
    return simhash.one_of_each(docs, COLUMNS)


@clearing
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of all texts; texts that lose words are joined by single spaces, others stay as
    they are. n_chars follows the text."""
    cut = debruijn.dedup_substrings(docs, keep=("doc_id", "lang", "source", "n_chars"), with_text=True)
    changed = F.col("n_removed") > 0
    left = cut.where(~changed | (F.col("n_words") > F.col("n_removed")))
    return left.select(
        "doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@clearing
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = queries.table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, items, keep=("doc_id", "lang", "source", "n_chars"), with_text=True)
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


@clearing
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    encoded = sentencepiece_scan.encode(docs, model, keep=("doc_id", "lang", "source"))
    back = sentencepiece_scan.decode(encoded, model)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids",
                       (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), name.replace(" ", "_"))
    clear(spark, sf_dir)
    return rows
