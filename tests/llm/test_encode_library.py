"""Ids against a fresh tokenizer, of which nothing is set."""

import random

import numpy as np
import pytest

ODD = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b c", "one <|ENDOFTEXT|> two", "<|startoftext|> x <|endoftext|>", "<|endof text|>", "H\u0331 and h\u0331", "E\u0301tude a\u030a", "T\u0308 J\u030c W\u030a", "\u212bngstrom \u212a", "\u0130stanbul \u03a3\u03a3", "", None]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_unaltered_librarys(name):
    from bytesift.llm.encode import Encoder, vocabulary
    from tokenizers import Tokenizer

    path = vocabulary(name)
    fresh = Tokenizer.from_file(path)
    rng = random.Random(3)
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    words = ["plain", "words", "Über", "naïve", "ЁЖ", "12", "it's", "H\u0331", "e\u0301", *added, *[t.upper() for t in added]]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(200)]
    for text, ids in zip(texts, Encoder(path).encode(texts), strict=True):
        assert ids.tolist() == fresh.encode(text or "", add_special_tokens=False).ids, text


def test_store_holds_the_librarys_ids(spark, docs_of):
    from bytesift.llm.common import scratch_path
    from bytesift.llm.encode import vocabulary
    from bytesift.llm.store import read_ids, write_store
    from tokenizers import Tokenizer

    vocab, path = vocabulary("word_bpe_49k.json"), scratch_path(spark, "store")
    rows = [(1, "one <|endoftext|> two"), (2, "H\u0331 plain"), (3, "last")]
    write_store(docs_of(rows), path, vocab, end_id=1)
    fresh = Tokenizer.from_file(vocab)
    want, start = {}, 0
    for i, text in rows:
        ids = [*fresh.encode(text, add_special_tokens=False).ids, 1]
        want[i] = (start, ids)
        start += len(ids)
    assert {r.doc_id: (r.start, np.frombuffer(r.ids, "<u2").tolist()) for r in read_ids(spark, path).collect()} == want


def test_words_go_to_the_model_alone():
    """Words, with punctuation or without, need no second normalizing and cutting; equal ones are looked up once."""
    from bytesift.llm.encode import Encoder, vocabulary
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    rng = random.Random(6)
    letters = "abcxyzéßжяά"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(300)]
    around = [("", ""), ("(", ")"), ('"', '."'), ("", "'"), ("", "!?"), ("-", ",")]
    texts = [" ".join(rng.choice("  \n").join([a + w + b, w.upper()]) for w in words for a, b in [rng.choice(around)]) for _ in range(20)]
    sent = []

    class Counting(Encoder):
        def _library(self, texts):
            sent.extend(texts)
            return super()._library(texts)

    enc = Counting(path)
    sent.clear()
    got = enc.encode(texts)
    assert sent == []
    fresh = Tokenizer.from_file(path)
    contractions = ["it's 'tis 'they (they'll) don't", "x'S 's '", "   ", "12ab a1 ²x"]
    for text, ids in zip(texts + contractions, [*got, *enc.encode(contractions)], strict=True):
        assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids, text
