import random

import numpy as np
import public_tokenizers as tokenizers
from tokenizers import Tokenizer

from shelfline.llm import plane_files

PATH = tokenizers.path("word_bpe_49k.json")


def test_spelled_special_tokens_have_the_library_ids(llm, tmp_path):
    library = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|startoftext|>", "Xy.<|endoftext|>Z,'s<|endoftext|>", "<|ENDOFTEXT|> x", "<|endof text|>"]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "A", "é", "é", "́", " ", "\n", " ", ".", "'s", "12", "İ"]
    draw = random.Random(7)
    texts += ["".join(draw.choices(parts, k=draw.randrange(1, 9))) for _ in range(2000)]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plane_files.write_token_files(docs, str(tmp_path / "ids"), PATH)
    rows = plane_files.read_token_files(llm, str(tmp_path / "ids")).orderBy("doc_id").collect()
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == expected
    assert expected[0] == [320, 49407, 321]
