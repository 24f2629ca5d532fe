"""What operators leave in the shared folder."""

import os

import public_tokenizers

from sonority.llm import alignment, jaccard_join, prefix_trie
from sonority.llm.common import shared_dir
from tests.llm.helpers import documents


def left(spark, make):
    """Names of the folders that are new after ``make`` and its result's use, without their numbers."""
    before = set(os.listdir(shared_dir(spark)))
    found = make()
    found.count()
    return sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(shared_dir(spark))) - before)


def test_new_operators_leave_their_results_only(spark):
    rows = [(i, f"one two three four five six {i // 3}") for i in range(12)]
    docs = documents(spark, rows)
    turns = spark.createDataFrame([(1, t, "u", f"t{t}") for t in range(20)], "conv_id long, turn long, role string, text string")
    assert left(spark, lambda: jaccard_join.jaccard_classes(docs)) == ["classes"]
    assert left(spark, lambda: alignment.cross_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))) == ["alignment"]
    assert left(spark, lambda: prefix_trie.prefix_trie(turns)) == ["trie"]


def test_pipeline_leaves_no_stage_behind(spark, sf_dir):
    import corpus_pipeline

    found = left(spark, lambda: corpus_pipeline.run(spark, sf_dir))
    stages = [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]]
    assert [f for f in found if f in stages] == stages[-1:]
    assert not {"cc-edges", "fingerprints", "distinct", "groups", "gone", "sizes", "mix"} & set(found)
