import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    pick = random.Random(5)
    letters = [chr(c) for c in [*range(0, 0x3000), 0x180E, 0x200B, 0xFEFF, 0x1F600, 0x10FFFF, 0x20000, 0xAC00]]
    fixed = ["", " ", "a" * 5000, " " * 3000 + "x", "<|endoftext|>a <|endoftext|>", "ab" * 3000, "0" * 777, "\n" * 50, "it's 'we'll ''s"]
    mixed = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 40))) for _ in range(2000)]
    plain = ["".join(pick.choice("aeinrst \n'dle") for _ in range(300)) for _ in range(200)]
    return fixed + mixed + plain


def test_same_ids_as_the_library(library):
    want = [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]
    got = [i.tolist() for i in bpe.vocabulary(PATH).encode(texts())]
    assert got == want


def test_pair_check_agrees_with_merging(library):
    import numpy as np

    tables = bpe.vocabulary(PATH)
    pick = np.random.default_rng(3)
    a, b = pick.integers(0, 50256, 20000), pick.integers(0, 50256, 20000)
    good = tables.compatible(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        assert g == (tables.merge_exactly(tables.bytes_of[x] + tables.bytes_of[y]) == [x, y])


def test_frame_round_trip_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "Hello world", 7), (1, "Hello world", 7), (None, None, None), (3, "", 0), (4, "naïve \U0001f600 text" * 2000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert got.count() == 5
    assert sorted(map(str, bpe.encode(docs, PATH, decoded="decoded").collect())) == sorted(map(str, got.collect()))
    assert got.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert bpe.digests(bpe.decode(bpe.encode(docs.limit(0), PATH), PATH)).count() == 0
