"""From raw documents to token ids in five stages, each of which reads what the one before has kept.

Every stage is written as Parquet and read again, so a lost executor costs one stage's work at most.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.llm import exact_copies, mixing, queries, sentencepiece_codec, simhash, toxicity
from linkwell.storage import discard, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score 0.7 or more go.

    Null and empty texts have no sentence and stay; texts of any length are scored whole; repeated rows are judged
    alike; nulls in other columns and extra columns have no part in it, and only the columns of documents are returned.
    """
    return toxicity.keep_clean(docs.select(*COLUMNS), queries.toxicity_model(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal whole texts the largest doc_id stays.

    A null text equals an empty one, a null id loses against any other; of rows that repeat id and text one stays.  An
    empty table stays empty.
    """
    return exact_copies.drop_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component the smallest doc_id stays.

    Texts without words, null ones among them, form one component with what is near to them.  If rows repeat the
    smallest id, the text of the smallest digest stays; components of null ids only keep their rows.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: a document stands as often as the mix takes it, so not at all, once or twice.

    Null sources are a source; null and empty texts have no words, so they stay as often as their hash says and
    count for nothing.  Repeated rows are taken one by one.
    """
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids with an end id, their number and digests, for every row.

    Null texts are encoded as empty ones, to the end id alone; repeated rows give repeated results.
    """
    return sentencepiece_codec.encode_decode(docs, queries.tokenizer_model(), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact copies", drop_exact_copies),
    ("SimHash near copies", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the learnt stage nor the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k + 1}")
            discard(read)
    return docs
