import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, byte_bpe

from .conftest import EDGES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.lists(st.sampled_from([*" \n\t\x00\x1c\xa0aAbcdeE'sltv019.,!é漢🙂", "the", " of", "  ", "<s>", "<0x41>", "<|endoftext|>", "▁", "the end"])).map("".join)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b, byte_bpe.token_bytes(a)


def piece_bytes(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def plain(libraries, text):
    """(ids, ends) of both sides by the libraries alone; nothing if the bytes differ."""
    a, b, table = libraries
    if not text:
        return ([], []), ([], [])
    whole = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [table[i] for i in ids[0]], [piece_bytes(b.id_to_piece(i)) for i in ids[1]]
    if any(b"".join(p) != whole for p in parts):
        return ([], []), ([], [])
    return tuple((i, np.cumsum([len(x) for x in p]).tolist()) for i, p in zip(ids, parts, strict=True))


def groups(side_a, side_b):
    """Groups of ids between common ends, one after the other."""
    common, out = sorted(set(side_a[1]) & set(side_b[1])), []
    for cut in common:
        before = common[common.index(cut) - 1] if cut != common[0] else 0
        out.append(tuple([i for i, e in zip(*side, strict=True) if before < e <= cut] for side in (side_a, side_b)))
    return out


def brute(libraries, rows):
    each = [(doc_id, *plain(libraries, text)) for doc_id, text in rows]
    linked = [[(i, j) for i, e in zip(*a, strict=True) for j, f in zip(*b, strict=True) if e == f] for _, a, b in each]
    count = Counter(pair for pairs in linked for pair in pairs)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (doc_id, a, b), pairs in zip(each, linked, strict=True):
        made = groups(a, b)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in made)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if made else ""
        n_best = sum(count[p] == best[p[1]] for p in pairs)
        out.append((doc_id, len(a[0]), len(b[0]), len(made), len(pairs), n_best, sum(count[p] for p in pairs), digest))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(TEXT, st.text(max_size=50), st.builds(lambda c, n: c * n, st.sampled_from("a =.é0 "), st.integers(0, 70))))
def test_parts_have_the_ids_of_the_whole(libraries, sides, text):
    text = text.encode("utf-8", "ignore").decode()
    a, b, _ = libraries
    if text:
        # a part that has U+2581 gives back another text and is left out
        assert "▁" in text or sides[1](text).tolist() == b.encode(text)
        assert sides[0](text).tolist() == a.encode(" " + text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteSide(A), alignment.PieceSide(B)


def test_against_the_libraries(spark, libraries, edges):
    rows = [(i, t) for i, t, *_ in EDGES]
    rows += [(20, "a▁b"), (21, "<s> <|endoftext|> </s>"), (22, "tab\tand \n\n new  lines   "), (23, " "), (24, "a b " * 50)]
    rows += [(30 + i, f"Unbelievable tokenisation number {i * 977}, naïve café {'x' * i}") for i in range(40)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, pairs string")
    expected = brute(libraries, [r for r in rows if (r[1] or "") != "word " * 30_000])
    got = sorted(map(tuple, alignment.align(frame.filter("coalesce(length(text), 0) < 100000"), A, B).collect()), key=str)
    assert got == expected and sum(not r[-1] for r in expected) == 4
    assert alignment.align(frame.repartition(5), A, B).count() == len(rows)
    assert alignment.align(edges.limit(0), A, B).collect() == []


def test_overlaps(spark, libraries):
    texts = [(i, t) for i, t in enumerate(["Unbelievable naïve café 12345", "", None, "漢字 🙂 x", "  two  spaces", "a▁b"])]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for row in alignment.overlaps(frame, A, B).collect():
        (ids_a, ends_a), (ids_b, ends_b) = plain(libraries, texts[row["doc_id"]][1])
        assert (row["a_ids"], row["a_ends"], row["b_ids"], row["b_ends"]) == (ids_a, ends_a, ids_b, ends_b)
        spans = [list(zip([0, *ends], ends)) for ends in (ends_a, ends_b)]  # noqa: B905
        both = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(row["over_a"], row["over_b"], strict=True)) == both
        assert row["cuts"] == sorted(set(ends_a) & set(ends_b))


def test_counts_are_of_the_whole_corpus(spark):
    """The same text in two tables is worth what the rest of its table makes of it."""
    once = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    more = once.unionAll(spark.createDataFrame([(i, "hello") for i in range(2, 12)], "doc_id long, text string").repartition(4))
    (alone,) = alignment.align(once, A, B).collect()
    (among,) = alignment.align(more, A, B).filter(F.col("doc_id") == 1).collect()
    assert among["count_sum"] == alone["count_sum"] + 10 and among["groups_sha256"] == alone["groups_sha256"]
