"""Token ids of texts that hold the literals of added tokens, against the plain tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers


def test_added_tokens_keep_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from skein.llm import token_output

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["end of page <|endoftext|> next page", "<|endoftext|> <|startoftext|> </w>", "a<|endoftext|>b, x<|startoftext|>!", "<|ENDOFTEXT|> plain", "<|endoftext|>", "plain words only"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_output.write_tokens(documents, str(tmp_path / "tokens"), path, end=1)
    rows = {r["doc_id"]: r for r in token_output.read_tokens(spark, str(tmp_path / "tokens"), with_ids=True).collect()}
    start = 0
    for k, text in enumerate(texts):
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids"]) == (start, len(ids), ids), text
        assert rows[k]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert rows[0]["ids"] == [806, 539, 2504, 49407, 1131, 2504, 1]
