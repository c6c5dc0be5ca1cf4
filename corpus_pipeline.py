"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage works on all that its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import decontamination, language_id, mixing, simhash, token_files
from talkloom.llm.common import crc_part, stored, table

#: SQL can't express the kernel classifier or the fingerprints' hash.
ORACLE_SQL = None


def _aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Columns of these names under others, so that an operator may add its own."""
    return docs.withColumnsRenamed({c: f"_kept_{c}" for c in docs.columns if c in names})


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, after :func:`_aside`."""
    return found.select(*[F.col(f"_kept_{c}" if f"_kept_{c}" in found.columns else c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows.

    Those go whose text is null or letterless, or in none of the learned languages
    (see ``language_id``). Where nothing could be learned, all stay. Repeated rows
    stay or go together; columns that clash keep their values; no rows give none.
    """
    model = language_id.fit(docs.where(crc_part("doc_id", 5) != 0))
    if not model.langs:
        return docs
    found = language_id.predict(_aside(docs, ("lang_pred", "score")), model, refuse=True)
    return _back(found.where(f"lang_pred <> '{language_id.NOTHING}'"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id.

    Null and wordless texts are one group. Null ids come last in a group and are
    deduplicated like others; of equal ids the least hash of all columns decides, of equal rows one stays; two
    texts of one id stay both unless they link. Columns of any name stay as they are.
    """
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and wordless texts hold none and stay, as all do where the benchmark has
    no words. Each row is judged by itself, whatever its id; columns that clash keep their values.
    """
    ours = _aside(docs, ("n_words", "n_hit", "items", "spans"))
    found = decontamination.contamination(ours, table(spark, sf_dir, "benchmark"), keep=ours.columns)
    return _back(found.where("n_hit = 0"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken twice is there twice.

    A null source is one, last. Rows without words have no size and stay, as the
    budget is one of words. Equal rows are taken together, other rows of one or no
    id each by itself; columns of any name stay as they are.
    """
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row for each document.

    Null text has the end id alone; null ids come first, rows of one id by their
    text's MD5; repeated rows are written as often as they come; no rows give none.
    """
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
