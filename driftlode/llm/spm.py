"""SentencePiece models run by the tokenizers library.

The model file (a protobuf message) is read field by field. From it a tokenizer is rebuilt: the
normaliser with its character map and the metaspace marker, the pieces with their scores (unigram
models) or the merges that the scores imply (BPE models), and byte fallback. Texts are encoded in
batches by several threads, decoded again, and compared with what the sentencepiece library gives.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHED, LONGEST, BATCH = 200_000, 40, 512
LETTER = r"[^\W\d_]"
#: Runs of letters, or of other characters, each with the spaces before it.
PARTS = re.compile(rf" *{LETTER}+| *(?:[^\w ]|[\d_])+| +")
WORDS = re.compile(r" *[^ ]+| +")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message: varints as int, the others as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
            yield key >> 3, value
            continue
        if key & 7 == 2:
            n, at = varint(at)
        elif key & 7 in (1, 5):
            n = 8 if key & 7 == 1 else 4
        else:
            raise ValueError(f"wire type {key & 7} at byte {at}")
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What the model file says. Numbers of the fields are fixed values of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    @classmethod
    def read(cls, data: bytes) -> Model:
        out = cls()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trained = dict(fields(value))
                if trained.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models are supported")
                out.unigram, out.byte_fallback = trained.get(3, 1) == 1, bool(trained.get(35, 0))
            elif number == 3:
                rules = dict(fields(value))
                out.char_map, out.dummy_prefix, out.squeeze_spaces = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        return out

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """The pairs that make each piece, best score first: a pair of known pieces merges if its whole is one."""
        at = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for piece, score, kind in self.pieces:
            if kind in (NORMAL, USER) and len(piece) > 1:
                out += [(-score, at[piece], at[piece[:i]], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in at and piece[i:] in at]
        return [(a, b) for *_, a, b in sorted(out)]

    def build(self, prefix: bool = True):
        """The tokenizer of the tokenizers library; without ``prefix`` for parts from within a text."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if self.unigram:
            made = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback))
        else:
            made = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        steps = [normalizers.Precompiled(self.char_map)] if self.char_map else []
        if self.squeeze_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += ([normalizers.Prepend(SPACE)] if self.dummy_prefix and prefix else []) + [normalizers.Replace(" ", SPACE)]
        made.normalizer = normalizers.Sequence(steps)
        made.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        made.add_tokens([AddedToken(p, normalized=True, special=False) for p, _, kind in self.pieces if kind == USER])
        return made

    def parts(self) -> re.Pattern | None:
        """What cuts a text so that no merge crosses a cut; None if texts are to be encoded whole.

        A merge joins what stands side by side in a piece. So texts may be cut before spaces if no
        piece has a marker behind another character, and between letters and other characters
        if no piece has the two side by side.
        """
        known = [p.lstrip(SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER)]
        if self.unigram or self.char_map or self.squeeze_spaces or any(SPACE in p for p in known) or any(kind == USER for *_, kind in self.pieces):
            return None
        mixed = re.compile(rf"{LETTER}[\W\d_]|[\W\d_]{LETTER}")
        return WORDS if any(mixed.search(p) for p in known) else PARTS


@lru_cache(maxsize=2)
def _loaded(path: str):
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # threads of a batch, for each worker
    with open(path, "rb") as f:
        model = Model.read(f.read())
    return model, model.build(), model.build(prefix=False)


@lru_cache(maxsize=2)
def _other(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Codec:
    """Encode and decode batches of texts.

    Where no merge crosses certain places (see Model.parts), texts are cut there and parts seen before
    aren't encoded again; the new ones of a batch are encoded together, by several threads. Else whole texts are.
    """

    def __init__(self, path: str):
        self.model, self.tokenizer, self.inner = _loaded(path)
        cut = self.model.parts()
        self.cut = None if cut is None else cut.findall
        self.known: dict[str, bytes] = {}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in self.model.pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.cut is None:
            return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        begin = " " * self.model.dummy_prefix
        cut = [([begin + t] if SPACE in t else self.cut(begin + t)) if t else [] for t in texts]  # a marker in the text joins like a space
        if len(self.known) > CACHED:
            self.known = {}
        new = list({p for parts in cut for p in parts}.difference(self.known))
        codes = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.inner.encode_batch_fast(new, add_special_tokens=False)]
        self.known.update(zip(new, codes, strict=True))
        out = [b"".join(map(self.known.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids. Whole bytes are joined where that gives valid text; else the library decides."""
        if self.cut is None:
            return self._decode(ids)
        out = []
        for x in ids:
            data = b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(x) // 4}I", x)))
            try:
                text = data.decode()
                out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
            except UnicodeDecodeError:
                out += self._decode([x])
        return out

    def _decode(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([struct.unpack(f"<{len(x) // 4}I", x) for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=1)
def _codec(path: str) -> Codec:
    """The worker's codec: the parts that a task has seen serve the next one."""
    return Codec(path)


def _coded(path: str, keep_ids: bool, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = [(t or "") for t in batch.column(1).to_pylist()]
                ids = codec.encode(texts)
                back = codec.decode(ids)
                columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([a == b for a, b in zip(back, texts, strict=True)])]
                names = ["id", "n_tokens", "ids_crc32", "round_trip"]
                if check:
                    same = [struct.pack(f"<{len(e)}I", *e) == x for e, x in zip(_other(path).encode(texts, num_threads=1), ids, strict=True)]
                    columns.append(pa.array(same))
                    names.append("parity")
                if keep_ids:
                    columns += [pa.array(ids, pa.binary()), pa.array(back, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, check: bool = True) -> DataFrame:
    """A row per document: n_tokens, ids_crc32, round_trip, parity, and the ids (binary) and decoded text if kept.

    round_trip: the decoded text is the text; parity: sentencepiece gives the same ids. Null and empty
    texts have no tokens and hold both. Repeated rows and null ids come back; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", parity boolean" * check + ", ids binary, decoded string" * keep_ids
    return rows.mapInArrow(_coded(model_path, keep_ids, check), schema).withColumnRenamed("id", id_col)
