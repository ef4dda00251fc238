"""The pipeline against its stages by brute force: verdict tables, all pairs, a ranked mix in Python and the tokenizers library."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_mixing_sharding import brute_copies, brute_targets
from test_nearcopies import brute_first
from test_selection import WORD
from tokenizers import Tokenizer

from factloom.llm import quality, rules


def test_pipeline(spark, sf_dir, documents):
    good = quality.verdicts(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))[0].where("kept").select("doc_id")
    first = documents.join(good, "doc_id")
    regular = first.join(rules.verdicts(first).where("kept").select("doc_id"), "doc_id").collect()
    stay = brute_first({r["doc_id"]: r["text"] for r in regular})
    left = [r for r in regular if r["doc_id"] in stay]

    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in left}
    sizes, text = Counter(), {r["doc_id"]: r["text"] or "" for r in left}
    for r in left:
        sizes[r["source"]] += size[r["doc_id"]]
    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for (doc, _, _), copies in brute_copies([(r["doc_id"], r["source"], size[r["doc_id"]]) for r in left], brute_targets(sizes)).items():
        ids = tokenizer.encode(text[doc], add_special_tokens=False).ids
        expected[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += copies
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert found == +expected


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(stage, spark, sf_dir, documents):
    nulls = documents.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in documents.schema.fields])
    for docs in (documents.limit(0), nulls):
        assert stage(spark, docs, sf_dir).columns == documents.columns
        assert stage(spark, docs, sf_dir).count() <= docs.count()
