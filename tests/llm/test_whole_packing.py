"""Added tokens in texts."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from driftlake.llm import packing

PATH = str(P.path("byte_bpe_50k.json"))


def test_added_tokens_have_their_ids(spark, tmp_path):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|> \n<|endoftext|><|endoftext|>é", "<|endoftext|", "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    theirs = Tokenizer.from_file(PATH)
    assert theirs.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    rows = {r.doc_id: r for r in packing.op10_packing(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        assert (rows[i].length, rows[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
