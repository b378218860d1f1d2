import os
import random

import pytest

from sievewright.llm import token_counts as T
from sievewright.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def long_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéüñ") for _ in range(rng.randrange(1, 12)))
    return {
        "prose": " ".join(word() for _ in range(3000)),
        "lines": "\n\n  ".join(f"{word()}'s {rng.randrange(10**6)}{word()}--don't" for _ in range(900)),
        "one word": "a" * 9000,
        "blanks": " " * 5000 + "x" + "\n" * 5000,
        "cjk": "".join(rng.choice("日本語文字列東京，。") for _ in range(4000)),
        "no break": "".join(rng.choice("語字") for _ in range(3000)),
        "controls": "a\x1c b\x85c\xa0  d" * 700,
        "emoji": "👩‍👩‍👧 ok 👍🏽" * 600,
        "special": "<|endoftext|> '" * 800,
    }


def test_spliced_encodings_are_exact():
    encode, size = T.load(VOCABULARY)
    for name, t in long_texts().items():
        for chunk, overlap in ((256, 16), (1000, 64)):
            parts = list(T.encode_long(t.encode(), encode, size, chunk, overlap))
            assert [x for p in parts for x in p.tolist()] == encode(t), (name, chunk)
    assert len(list(T.encode_long(long_texts()["prose"].encode(), encode, size, 1000, 64))) > 5


def test_counts_and_edge_cases(docs_of):
    encode, _ = T.load(VOCABULARY)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), *((10 + i, t) for i, t in enumerate(long_texts().values()))]
    df = docs_of(rows).selectExpr("*", "5 AS n_tokens", "6 AS n_pieces")
    out = T.count_tokens(df, VOCABULARY, chunk=2000, overlap=32)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out.collect()) == sorted((str(i), len(encode(t or ""))) for i, t in rows)
    assert T.count_tokens(docs_of([]), VOCABULARY).count() == 0
