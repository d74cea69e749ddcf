"""The ids of packed documents are the library's at its default setting."""

import random
import zlib

import numpy as np
import public_tokenizers as tokenizers
from tokenizers import Tokenizer

from seqprism.llm import packing


def test_added_tokens_as_the_library_does(spark):
    file = tokenizers.path("byte_bpe_50k.json")
    library, own, draw = Tokenizer.from_file(file), packing.DocumentTokenizer(file), random.Random(6)
    parts = ["a", " the", "ing", " ", "\n", "'s", "é", "1", "<|endoftext|>", "<|endoftext|", "|>"]
    texts = ["", "<|endoftext|>", " <|endoftext|> ", *("".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(2000))]
    for t in texts:
        assert np.frombuffer(own.pack_document(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, "one <|endoftext|> two")], "doc_id long, text string")
    ids = [*library.encode("one <|endoftext|> two", add_special_tokens=False).ids, 0]
    assert 50256 in ids and packing.pieces(df, file).first().ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
