"""Texts that hold a vocabulary's added tokens, against the library with its defaults."""

import numpy as np
import pytest

from strandline.llm import codec, packing
from strandline.llm.common import work_path
from strandline.llm.tokens import encode, vocabulary_path

ENDS = ["<|endoftext|>", "<|startoftext|>"]
TEXTS = [f"{a}{e}{b}" for e in [*ENDS, *(e.upper() for e in ENDS), "<|EndOfText|>"] for a in ("", "ok ", "ok", "line\n", "a,  ", "é") for b in ("", " go", "go", "\n\nnext", ". End", e)]
TEXTS += ["ok <|endoftext|> go " + "plain words, here. " * 200, "<|endoftext", "endoftext|>", "<| endoftext |>", "", "nothing here"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(name))
    ids, n = encode(TEXTS, vocabulary_path(name))
    for text, got in zip(TEXTS, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts(name):
    """Words, marks, white space and letters of many kinds in random order, also after the word table was trimmed."""
    import random

    from tokenizers import Tokenizer

    from strandline.llm import tokens

    pick = random.Random(12)
    units = ["the", "The", "THE", "don't", "it's", "I'LL", "x1", "1234", "é", "Élan", "straße", "İstanbul", "ﬁn", "日本", "🙂", "a\u0301", "...", "?!", "%%%", "-", "_", "'", "''", "\u00a0", "\u2003", "\t", "\n", "\n\n", " ", "  ", "\r", "\0", "<|", "word", "ñandú", "Ǆ", "ǅ", "ª", "²", "½", "'s", ",", "."]
    texts = ["".join(pick.choice(units) + pick.choice(["", " ", " ", "\n"]) for _ in range(pick.randrange(1, 40))) for _ in range(4000)]
    library = Tokenizer.from_file(vocabulary_path(name))
    table = tokens._words(vocabulary_path(name))
    for turn in range(2):
        for s in range(0, len(texts), 500):
            part = texts[s : s + 500]
            ids, n = encode(part, vocabulary_path(name))
            for text, got in zip(part, np.split(ids, np.cumsum(n)[:-1])):
                assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], repr(text)
            if turn:
                table.trim()


def test_lengths(spark):
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    size = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(vocabulary_path(name))
        size[name] = [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in TEXTS]
    packed = packing.pack_documents(df).groupBy("doc_id").sum("length").collect()
    assert dict(map(tuple, packed)) == dict(enumerate(size["byte_bpe_50k.json"]))
    path = work_path(spark, "added-tokens")
    codec.write_token_files(df, path, vocabulary_path("word_bpe_49k.json"))
    at = np.cumsum([0, *size["word_bpe_49k.json"]])
    assert {r["doc_id"]: r["start"] for r in codec.file_digests(spark, path).collect()} == dict(enumerate(at[:-1].tolist()))
