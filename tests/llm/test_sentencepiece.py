import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from chunkloom.llm import sentencepiece_bpe as spb

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return spb.PieceBpe(spb.model_bytes(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encode_and_decode_match_the_library(both):
    ours, theirs = both
    r = random.Random(7)
    signs = "abcdeéèñthingaonre  \n\t.,;'-_09漢字𠮷▁\x00​<>/" + "the " * 3
    texts = ["", " ", "  ", "a", "\n", "x\x00y", "�", "</s>", "<0x41>", "a▁b", "é", " " * 500, "a" * 3000, "ab" * 2000, "th" * 999 + " " * 77 + "e"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(r.choice(" a") for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += ["".join(r.choice(theirs.id_to_piece(r.randrange(259, 32000))) for _ in range(8)) for _ in range(300)]
    texts += ["".join(theirs.id_to_piece(r.randrange(259, 32000)) for _ in range(6)) for _ in range(3000)]
    for t in texts:
        want = theirs.encode(t, add_eos=True)
        assert ours.encode(t) == want, t
        assert ours.decode(want) == theirs.decode(want), t


def test_decode_of_any_ids(both):
    ours, theirs = both
    r = random.Random(3)
    for _ in range(2000):
        ids = [r.choice([r.randrange(1, 400), r.randrange(32000), r.randrange(3, 259)]) for _ in range(r.randint(0, 12))]
        assert ours.decode(ids) == theirs.decode(ids), ids


def test_table(spark, both):
    _, theirs = both
    model = spb.model_bytes(PATH)
    rows = [(1, "The cat", "x"), (2, None, "y"), (3, "", None), (1, "The cat", "x"), (4, "word " * 30000, None), (None, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, spb.round_trip(df, model).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest(), True))
    assert got == sorted(want, key=repr)
    back = spb.decode_table(spb.encode_table(df, model), model)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(i, t or "") for i, t, _ in rows], key=repr)
    assert spb.round_trip(df.limit(0), model).count() == 0
