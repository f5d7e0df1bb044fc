"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field (no generated classes), its normaliser, metaspace marker, scores and byte
fallback are rebuilt as a tokenizers pipeline, and texts are encoded in multithreaded batches. Unigram models keep
their scores; for BPE models the merges follow from the scores of the pieces.

Where no piece has the marker after another character (checked when the model is loaded), pieces never cross from a
word into the next run of markers. Texts are then encoded by such stretches, each new one once, and every stretch is
checked against the SentencePiece library (parity) and decoded back (round trip) as it is first met.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; a null doc_id is kept; a
text of any length is encoded whole; of equal merges the one with the earlier parts comes first; extra columns are
ignored; what lies in the model (white space, case) is kept by its own normaliser; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import restrict, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of one protobuf message: integers as such, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls([])
        for key, value in wire(data):
            if key == 1:
                own = dict(wire(value))
                out.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif key == 2:
                own = dict(wire(value))
                out.kind, out.byte_fallback, out.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
            elif key == 3:
                own = dict(wire(value))
                out.charsmap, out.dummy_prefix, out.squeeze, out.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        out.unk_id = next((i for i, p in enumerate(out.pieces) if p[2] == UNKNOWN), 0)
        return out

    def separable(self) -> bool:
        """No piece holds the marker after another character, and nothing depends on the text around a word."""
        return any(p == MARK for p, _, _ in self.pieces) and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER)) and not (self.charsmap or self.squeeze or self.suffix) and self.dummy_prefix and self.escape


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs whose joining gives a piece, best piece first; of one piece's pairs the one with the earlier parts."""
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    out = []
    for piece, score, kind in model.pieces:
        if kind not in (NORMAL, USER):
            continue
        for n in range(1, len(piece)):
            left, right = piece[:n], piece[n:]
            if left in ids and right in ids:
                out.append((-score, ids[piece], ids[left], ids[right], left, right))
    return [(x[4], x[5]) for x in sorted(out)]


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    out = Tokenizer(core)
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


class Encoder:
    """Encodes whole texts; ``reference`` is the SentencePiece processor that parity is checked against."""

    def __init__(self, data: bytes, room: int = 300_000, reference: bool = True):
        self.model = Model.parse(data)
        self.tokenizer, self.room = build(self.model), room
        self.known = self._empty()
        self.reference = None
        if reference:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_stretch = self.model.separable()

    def _empty(self) -> dict[str, bytes | tuple[bytes, bool, bool]]:
        """A marker alone, as after a space at the end, is a stretch without further characters.

        A stretch that passed both checks is kept as its ids alone, which is nearly all of them.
        """
        return {"": b"".join(struct.pack("<I", i) for i, p in enumerate(self.model.pieces) if p[0] == MARK)}

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        same = [True] * len(ids) if self.reference is None else [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=1), strict=True)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        expect = texts if not self.model.charsmap and not self.model.squeeze else self.reference.decode(ids) if self.reference else back
        return [(np.array(i, dtype="<u4").tobytes(), s, b == t) for i, s, b, t in zip(ids, same, back, expect, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """For each text its ids (little-endian, 32 bits), whether SentencePiece agrees, and whether decoding gives the text."""
        if not self.by_stretch:
            full = iter(self._whole([t for t in texts if t]))
            return [next(full) if t else (b"", True, True) for t in texts]
        if len(self.known) > self.room:
            self.known = self._empty()
        # the marker goes before the text; each stretch then starts with its markers, of which the first is implied
        split = [stretches(t) if t else [] for t in texts]
        new = list({s for row in split for s in row} - self.known.keys())
        if new:
            self.known |= {s: got[0] if got[1] and got[2] else got for s, got in zip(new, self._whole(new), strict=True)}
        known, out = self.known, []
        for row in split:
            parts = [known[s] for s in row]
            try:
                out.append((b"".join(parts), True, True))
            except TypeError:  # some stretch failed a check
                full = [p if isinstance(p, tuple) else (p, True, True) for p in parts]
                out.append((b"".join([p[0] for p in full]), all(p[1] for p in full), all(p[2] for p in full)))
        return out

    _kept: dict[tuple[int, int, int], Encoder] = {}

    @classmethod
    def kept(cls, data: bytes, room: int = 300_000) -> Encoder:
        """The encoder of a model in this process; tasks that follow each other share what it knows."""
        key = (len(data), zlib.crc32(data), room)
        if key not in cls._kept:
            cls._kept = {key: cls(data, room)}
        return cls._kept[key]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_RUNS = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def stretches(text: str) -> list[str]:
    """Runs of markers with the characters up to the next run; each without its first marker, which the normaliser
    sets before a text anyway."""
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


_OUT = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"


def encode_documents(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, parity, round_trip), one row for each row of ``docs`` (doc_id, text).

    ``model`` holds the bytes of a model file; a few hundred kB go out with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        encoder = Encoder.kept(model)
        for batch in slices(batches, "text"):
            got = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([zlib.crc32(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])],
                names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"],
            )

    return restrict(docs, "doc_id", "text").mapInArrow(run, _OUT)


def encoded(docs: DataFrame, model: bytes, threads: int = 2, room: int = 100_000) -> DataFrame:
    """``docs`` (doc_id, source, text) as (doc_id, source, ids array<int>): the operator's real output.

    As the last of several stages it shares its workers' memory with them, so it remembers fewer stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        encoder = Encoder.kept(model, room)
        for batch in slices(batches, "text"):
            got = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("source"), pa.array([np.frombuffer(g[0], dtype="<u4").astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1] and g[2] for g in got])], names=["doc_id", "source", "ids", "verified"])

    return docs.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, ids array<int>, verified boolean")
