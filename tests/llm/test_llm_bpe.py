import base64
import random

import public_tokenizers as tokenizers
import tiktoken

from shelfline.llm import bpe

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding(
        "test", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_same_ids_as_tiktoken():
    ours, theirs, rng = bpe.ByteBpe(PATH, tokenizers.PATTERN), reference(), random.Random(1)
    texts = ["", " ", "x" * 5000, " " * 3000 + "a", "it's we'll \t\n  \n x", "<|endoftext|>", "a\x1cb \x85c"]
    for start in range(0, 0x3000, 97):
        marks = ["", " ", "a", "  ", "\n", "1"]
        texts.append("".join(rng.choice(marks) + chr(c) for c in range(start, start + 97)))
    for text in texts:
        ids = ours.encode(text).tolist()
        assert ids == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_every_token_is_reached_by_the_serialised_model():
    tokens = bpe.read_ranks(PATH)
    codec = bpe.ByteBpe(PATH, tokenizers.PATTERN)
    for rank in range(0, len(tokens), 97):
        assert codec._model.EncodeAsIds(bpe.spelled(tokens[rank])) == [rank]


def test_frames(odd_docs, no_docs):
    theirs = reference()
    encoded = bpe.encode(odd_docs, PATH, tokenizers.PATTERN, odd_docs.columns)
    assert sorted(encoded.columns) == sorted(odd_docs.columns)
    decoded = bpe.decode(encoded, PATH, tokenizers.PATTERN, ["text", "ids"]).collect()
    for row in decoded:
        assert row["ids"] == theirs.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.encode(no_docs, PATH, tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_one_pass_gives_the_same(odd_docs, no_docs):
    keep = [c for c in odd_docs.columns if c != "ids"]
    once = bpe.encode_and_decode(odd_docs, PATH, tokenizers.PATTERN, keep)
    twice = bpe.decode(
        bpe.encode(odd_docs, PATH, tokenizers.PATTERN, keep), PATH, tokenizers.PATTERN, [*keep, "ids"]
    )
    assert sorted(once.columns) == sorted(twice.columns)
    assert sorted(map(repr, once.select(*twice.columns).collect())) == sorted(map(repr, twice.collect()))
    assert bpe.encode_and_decode(no_docs, PATH, tokenizers.PATTERN, ["doc_id"]).count() == 0
