from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from telespark.llm import tokens
from telespark.llm.common import saved, table
from tests.conftest import SF


def test_stages_in_turn(spark):
    docs = first = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, docs, SF), name)
        assert after.columns == first.columns
        assert after.join(docs, docs.columns, "left_anti").count() == 0, f"{name} changes rows"
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    t = Tokenizer.from_file(tokens.default_tokenizer())
    ids = {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids + [1] for r in docs.collect()}
    assert {r["doc_id"] for r in pieces} == set(ids)
    for r in pieces:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
