"""From raw documents to packed training windows, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of documents, in their order, whatever further
columns there are.

Defined cases: null, empty and blank texts are kept by toxicity unless no words score as toxic, left alone by line_dedup, alike for near_dedup, of
0 tokens for mixing, and one end id for packing. Rows with a null doc_id are scored and cut like any other; near_dedup keeps one only
if no row of its group has an id. Of repeated rows near_dedup keeps one; of equal texts the row of the least id. A stage of an empty
table is an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.llm import linededup, mixing, neardup, packing, simhash, toxicity
from contestlab.llm.common import discard, materialize, scratch, table

#: No SQL can train the classifier or tokenise.
ORACLE_SQL = None
#: Share of the tokens that mixing keeps.
KEEP = mixing.KEEP


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those at hand, scores as toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows, and later copies of shorter texts, are cut out; n_chars follows the text."""
    cut = linededup.deduplicate_lines(docs, short=True)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; texts are linked by SimHash chains, and down to a five-word Jaccard similarity of 0.8."""
    return simhash.keep_one_of_each(docs, groups=neardup.near_groups(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of KEEP of all tokens are sampled to tempered shares of source, language and topic."""
    return mixing.sample_to_targets(docs, keep=KEEP)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each wrote on its way, and its predecessor's documents, are deleted once its own are stored."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch():
            docs = materialize(stage(spark, before, sf_dir), name, keep=True)
        if i:
            discard(before)
    return docs
