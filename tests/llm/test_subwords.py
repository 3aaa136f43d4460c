"""Merge-type pieces against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import queries, subwords

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return subwords.Model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_equal_the_library_on_mixed_characters(model, library):
    rng, encoder, decoder = random.Random(3), subwords.Encoder(model), subwords.Decoder(model)
    letters = "aaabeehnot      \n\n.▁0123é日本🙂\x00́ß"
    pieces = [p.replace("▁", " ") for i, p in enumerate(model.pieces) if model.kinds[i] == subwords.NORMAL]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    made += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    made += [c * n for c in " a.0=-▁\ne日" for n in range(1, 80)]
    for text in made:
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids_of(encoder.encode(text)) == want, text
        assert decoder.decode(encoder.encode(text)) == library.decode(want), text


def test_any_ids_decode_like_the_library(model, library):
    rng, decoder = random.Random(5), subwords.Decoder(model)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(subwords.packed(ids)) == library.decode(ids), ids


def test_pairs_are_compatible_just_when_merging_their_text_gives_them_back(model):
    """The growing test against plain merging, on a small made vocabulary with tied scores."""
    def merged(text, ranks):
        parts = list(text)
        while True:
            ways = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not ways:
                return parts
            k = min(ways)[1]
            parts[k: k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(8)
    for _ in range(30):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(25)} | {"a", "b"}
        made = object.__new__(subwords.Model)
        made.pieces, made.kinds = sorted(words), [subwords.NORMAL] * len(words)
        made.scores = [float(-rng.randint(0, 12)) for _ in words]
        made.prefix = made.bytes = False
        made.unknown = made.begin = made.end = 0
        encoder = subwords.Encoder(made)
        for left in range(len(made.pieces)):
            for right in range(len(made.pieces)):
                two = [made.pieces[left], made.pieces[right]]
                assert encoder.compatible(left, right) == (merged("".join(two), encoder.ranks) == two)
        for _ in range(50):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))
            assert [made.pieces[i] for i in ids_of(encoder.encode(text, False, False))] == merged(text, encoder.ranks)


def test_remembered_words_do_not_change_results(model, monkeypatch):
    monkeypatch.setattr(subwords, "WORDS", 3)
    monkeypatch.setattr(subwords, "PAIRS", 5)
    small, text = subwords.Encoder(model), "the one and the other of the same and once more the one " * 4
    first = small.encode(text)
    monkeypatch.undo()
    assert first == subwords.Encoder(model).encode(text) and len(small) <= 3


def test_edge_rows(spark, library):
    long = "Thousands of words, " * 60_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, long, "x"), (5, "twice", "x"), (5, "twice", "x"), (6, "a▁b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = subwords.encode(docs, PATH, ["doc_id"])
    back = subwords.decode(found, PATH, ["doc_id", "ids"]).collect()
    assert len(back) == len(rows)
    for row in back:
        text = next(r[1] for r in rows if r[0] == row["doc_id"]) or ""
        assert ids_of(row["ids"]) == library.encode(text, add_bos=True, add_eos=True)
        assert row["decoded"] == text.replace("▁", " ")
    assert subwords.encode(docs.limit(0), PATH, ["doc_id"]).count() == 0
    assert subwords.decode(found.select("doc_id", F.lit(None).cast("binary").alias("ids")), PATH, ["doc_id"]).first()[1] == ""
    with pytest.raises(ValueError):
        subwords.encode(docs, PATH, ["doc_id", "ids"])


def test_other_models_are_refused(tmp_path, spark):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x0a\x05\x0a\x03abc\x12\x02\x18\x01")  # one piece, unigram type
    with pytest.raises(ValueError):
        subwords.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(path), ["doc_id"])


def test_query_equals_the_library(spark, sf, library):
    texts = {r[0]: r[1] or "" for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}
    found = queries.op11_sentencepiece(spark, sf).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row["doc_id"]], add_bos=True, add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
