"""What the driver keeps of byte-pair encoding."""

import public_tokenizers

from docloom.llm import bpe


def test_no_plan_spells_out_the_rank_map(spark):
    """The tables stood as literals in the plans, 18 million characters with each query that the driver remembers."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    found = bpe.digests(docs, ranks, public_tokenizers.PATTERN, shared=0)
    assert len(found._jdf.queryExecution().toString()) < 200_000
