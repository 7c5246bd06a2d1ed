"""The SentencePiece codec: a unigram model against the library, and the registered query."""

import random
import struct

import public_tokenizers
import pytest

from driftlode.llm import queries, spm

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model of the pieces of the BPE model, with scores of our own."""
    rng = random.Random(7)
    with open(PIECE, "rb") as f:
        pieces = spm.Model.read(f.read()).pieces
    scores = [0.0 if kind != spm.NORMAL else -rng.uniform(2, 9) - 3 / len(p) for p, _, kind in pieces]
    data = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(kind)) for (p, _, kind), s in zip(pieces, scores, strict=True))
    data += message(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + message(3, message(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(data)
    return str(path)


def test_unigram_parity(spark, sf_dir, unigram):
    """The same ids, or ids of the same pieces' total score: "%%%" may be cut in two ways."""
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = spm.encode_documents(docs, unigram).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert spm.Codec(unigram).cut is None and all(r.round_trip for r in out)
    sp = sentencepiece.SentencePieceProcessor(model_file=unigram)
    total = lambda ids: sum(map(sp.get_score, ids))
    for r in out:
        if not r.parity:
            assert abs(total(struct.unpack(f"<{r.n_tokens}I", r.ids)) - total(sp.encode(r.text))) < 1e-3 * r.n_tokens  # its sums are of single precision
    assert sum(r.parity for r in out) > 0.9 * len(out) and sum(r.n_tokens for r in out) > 10_000


def test_cuts_change_nothing():
    rng, codec, whole = random.Random(3), spm.Codec(PIECE), spm.Codec(PIECE)
    whole.cut = None
    signs = "ab  Zé漢.,%²½_9\n\t▁\U0001f600'"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(800)] + ["x" * 50_000, " " * 5000]
    assert codec.cut is not None and codec.encode(texts) == whole.encode(texts)
    assert codec.decode(codec.encode(texts)) == whole.decode(whole.encode(texts))


def test_the_registered_query(spark, sf_dir):
    out = queries.op4_sentencepiece(spark, sf_dir)
    assert out.where("not parity or not round_trip").count() == 0
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
