"""Ids of texts that hold an added token, against the contract's tokenizer."""

import zlib

import numpy as np

from ampline.llm import packing


def test_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts = [f for t in names for f in (f"a {t} b", t, f"{t}{t}", f"  {t}\n\n{t}  x", f"a{t[:-1]} {t[1:]}", f"é{t}ß 12 {t.upper()}")] + ["plain text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pack(df).collect()}
    ids = [np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert names and [rows[k] for k in range(len(texts))] == [(len(i), zlib.crc32(i.tobytes())) for i in ids]
