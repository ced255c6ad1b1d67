import random
import unicodedata

import public_tokenizers
import pytest
import tiktoken

from cairn.llm import bpe


@pytest.fixture(scope="module")
def pair():
    path, pattern = bpe.public()
    own = bpe.Codec(path, pattern)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.tokens, special_tokens={})


def test_against_tiktoken(pair):
    own, other = pair
    rng = random.Random(1)
    marks = [" ", "\n", "\t", "　", " ", "'s", "'ll", "!!", "é", "ß", "中文字", "العربية", "🙂", "é", "\x1c", "\x85", "​", "12", "٣", "<|endoftext|>", "\x00"]
    texts = ["", " ", "a", "a" * 5000, "ab" * 900, " " * 3000 + "x", "中" * 2000, "\n\n  \n x", "aäöü" * 400]
    for _ in range(400):
        texts.append("".join(rng.choice(marks + ["".join(rng.choices("abcdefghinorstuy", k=rng.randint(1, 30)))]) for _ in range(rng.randint(1, 60))))
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids == other.encode_ordinary(text), text[:60]
        assert own.decode(ids) == text.encode()


def test_every_character(pair):
    own, other = pair
    chars = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    texts = ["a" + "1 ".join(chars[i : i + 50]) + " b" for i in range(0, len(chars), 50)]
    bad = [t for t, ids in zip(texts, own.encode_batch(texts), strict=True) if ids != other.encode_ordinary(t)]
    assert not bad, bad[:2]


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello wörld", 5), (2, None, 5), (2, "", 5), (1, "hello wörld", 5)], "doc_id long, text string, n_tokens int")
    rows = bpe.digests(df, *bpe.public()).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted([0, 0, *[r["n_tokens"] for r in rows if r["doc_id"] == 1]])
    assert len(rows) == 4 and bpe.digests(df.limit(0), *bpe.public()).count() == 0
    path = bpe.public()
    back = bpe.decode(bpe.encode(df, *path), *path).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
