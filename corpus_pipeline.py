"""The training-data pipeline over documents: each stage works on all that the one before it kept.

Every stage but the last returns whole rows of its input, with all their columns, whatever these are named. A row is kept or dropped for its
own text, whatever its doc_id: ids may be null or repeat. Null texts count as empty in every stage, texts of any length are read whole, and
an empty table goes through all stages to an empty result.
"""

from twinframe.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from twinframe.llm.common import documents, table, written

#: Similarity in hundredths from which the pipeline counts documents as near-duplicates; op6's own contract is 85.
NEAR = 80


def toxicity_filter(spark, docs, sf_dir):
    """Documents that score under the threshold for toxicity."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_filter(spark, docs, sf_dir):
    """Of equal texts, the longest original stays; of those, the smallest doc_id, null last, then the first row. Empty texts are equal."""
    return exact_dedup.deduplicated(docs)


def near_dedup_filter(spark, docs, sf_dir):
    """Of each group of near-duplicates, the smallest doc_id stays, null last, then the first row. Texts without words are in no group."""
    return near_dedup.deduplicated(docs, NEAR)


def decontamination_filter(spark, docs, sf_dir):
    """Documents without a passage of the benchmark. Empty texts have none, and so has every text where the benchmark is empty."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 2048 tokens. An empty text is a piece of its end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("near_dedup", near_dedup_filter),
    ("decontamination", decontamination_filter),
    ("packing", packing_stage),
]
#: Token ids and nearest neighbours aren't expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents in turn; each but the last is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
