"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed field by field; its normaliser, metaspace marker, piece
scores and byte fallback are rebuilt as a tokenizers pipeline.  Unigram models keep their
scores; merge models get their merge list from the scores of the merged pieces.  Batches
are encoded on several threads.  ``parity`` compares the rebuilt tokenizer with the
sentencepiece library itself.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.llm.common import at, enter, pick, stored, text_slices

PIECE_MODEL = os.environ.get("PEDIGRAPH_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNK = 1 << 20


@dataclass(frozen=True)
class PieceModel:
    """What the encoder needs from a model file; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; numbers for varints, bytes for the rest."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        match key & 7:
            case 0:
                yield key >> 3, number()
                continue
            case 1:
                size = 8
            case 2:
                size = number()
            case 5:
                size = 4
            case other:
                raise ValueError(f"wire type {other} in a model file")
        yield key >> 3, data[at:at + size]
        at += size


def parse_model(data: bytes) -> PieceModel:
    """Field numbers are those of the public model format: 1 pieces, 2 trainer, 3 normaliser."""
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, MERGES):
        raise ValueError(f"model type {kind} is neither unigram nor merges")
    return PieceModel(pieces, kind, bool(trainer.get(35, 0)), trainer.get(40, 0), bool(trainer.get(24, 0)), normal.get(2, b""),
                      bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score of the third first, then longest parts."""
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    found = [(-score, -cut, -(len(p) - cut), ids[p[:cut]], ids[p[cut:]])
             for p, score, kind in model.pieces if kind in (NORMAL, USER)
             for cut in range(1, len(p)) if p[:cut] in usable and p[cut:] in usable]
    return [(model.pieces[a][0], model.pieces[b][0]) for *_, a, b in sorted(found)]


def rebuild(model: PieceModel):
    """The model as a tokenizers pipeline: normaliser, marker, pieces, decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_mark or not model.escape_spaces:
        raise ValueError("only models that mark the start of a word are supported")
    if model.kind == UNIGRAM:
        made = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback))
    else:
        made = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), byte_fallback=model.byte_fallback,
                                    unk_token=model.pieces[model.unknown][0], fuse_unk=True, cache_capacity=0))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    usable = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
    if not any(MARK in p.lstrip(MARK) for p in usable):
        # no piece runs from a character into a marker: runs of markers start independent parts
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return made


class Codec:
    """Encoder and decoder of one model.

    No piece of the usual models runs from a character into a marker, so a text falls into
    parts (markers and what follows) that encode on their own: distinct parts are encoded
    once, in threaded batches, and kept in a bounded store.  Other models encode whole texts.
    """

    LONGEST, STORED = 64, 300_000

    def __init__(self, data: bytes, verify: bool = False):
        import sentencepiece

        model = parse_model(data)
        self.tokens, self.bare = rebuild(model), rebuild(model)
        self.bare.normalizer = None
        usable = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
        self.splits = model.dummy_prefix and not any(MARK in p.lstrip(MARK) for p in usable)
        self.plain = not model.charsmap and not model.squeeze_spaces
        self.starts = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self.marks = np.array([not p.strip(MARK) for p, _, _ in model.pieces])
        self.prefixed = model.dummy_prefix
        self.bytes = {i: bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode()
                      for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, BYTE)}
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data) if verify else None
        self.store: dict[str, bytes] = {}
        self.wrong: set[str] = set()

    def _ids(self, tokens, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in tokens.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, ids: np.ndarray) -> list[bytes]:
        """Ids of joined parts as bytes, cut where a marker follows anything but a marker."""
        first = self.starts[ids]
        first[1:] &= ~self.marks[ids[:-1]]
        edges, raw = (4 * np.flatnonzero(first)).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)])]

    def _learn(self, parts: list[str]) -> None:
        groups = [parts[i:i + 4096] for i in range(0, len(parts), 4096)]
        found = self._ids(self.bare, ["".join(g) for g in groups])
        checked = [np.array(x, dtype=np.int32) for x in self.other.encode(["".join(g)[1:] for g in groups], num_threads=1)] if self.other else found
        for group, ids, same in zip(groups, found, checked):
            cut = self._cut(ids)
            if len(cut) != len(group):
                raise ValueError("parts of a text did not encode on their own")
            self.store.update(zip(group, cut))
            if not np.array_equal(ids, same):
                self.wrong.update(p for p, raw in zip(group, cut) if np.array(self.other.encode(p[1:]), np.int32).tobytes() != raw)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether all of its parts agree with the sentencepiece library (true where not verified)."""
        if not self.splits:
            ids = self._ids(self.tokens, texts)
            same = self.other.encode(texts, num_threads=1) if self.other else [i.tolist() for i in ids]
            return ids, [i.tolist() == s for i, s in zip(ids, same)]
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts] if self.plain else [self.tokens.normalizer.normalize_str(t) for t in texts]
        parts = [_PART.findall(t) for t in marked]
        if len(self.store) > self.STORED:
            self.store.clear()
        new = {p for row in parts for p in row}.difference(self.store)
        self._learn([p for p in new if len(p) <= self.LONGEST and p[-1] != MARK])
        odd = [p for p in new if len(p) > self.LONGEST or p[-1] == MARK]  # long, or markers that no character follows
        once = dict(zip(odd, (i.tobytes() for i in self._ids(self.bare, odd))))
        if self.other:
            lead = len(self.other.encode("a"))  # a marker alone cannot stand first: the prefix would be taken for it
            self.wrong.update(p for p, s in zip(odd, self.other.encode(["a" + p for p in odd], num_threads=1))
                              if np.array(s[lead:], np.int32).tobytes() != once[p])
        found = self.store if not once else ChainMap(once, self.store)
        ids = [np.frombuffer(b"".join(map(found.__getitem__, row)), dtype=np.int32) for row in parts]
        return ids, [not self.wrong or self.wrong.isdisjoint(row) for row in parts]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids: the bytes of their pieces; ids that the table cannot join go to the tokenizers decoder."""
        made = []
        for row in ids:
            row = row.tolist()
            try:
                text = b"".join(map(self.bytes.__getitem__, row)).decode()
                made.append(text.removeprefix(" ") if self.prefixed else text)
            except (KeyError, UnicodeDecodeError):
                made.append(self.tokens.decode(row, skip_special_tokens=False))
        return made


@functools.lru_cache(maxsize=2)
def codec(data: bytes, verify: bool = False) -> Codec:
    return Codec(data, verify)


stored(codec.cache_clear)


def _encode_batches(model, column: int, threads: int, verify: bool, round_trip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        enter("pieces")
        own = codec(model.value, verify)
        for batch in batches:
            lo = 0
            for part in text_slices(batch.column(column), _CHUNK):
                texts, hi = [t or "" for t in part], lo + len(part)
                ids, agreed = own.encode(texts)
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                made = [pa.array(np.diff(offsets)), lists]
                if verify:
                    made.append(pa.array(agreed))
                if round_trip:
                    made.append(pa.array([a == b for a, b in zip(own.decode(ids), texts)]))
                kept = batch.slice(lo, hi - lo)
                lo = hi
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[f"_{i}" for i in range(batch.num_columns + len(made))])

    return run


def encoded(docs: DataFrame, text_col: str = "text", model_path: str = PIECE_MODEL, threads: int = 2, verify: bool = False,
            round_trip: bool = False) -> DataFrame:
    """The rows with ``n_pieces`` and ``piece_ids``; optionally ``parity`` and ``lossless``.

    Whole texts are encoded; null and empty texts have no pieces.  ``parity`` holds where
    every part of the text gets the same ids from the sentencepiece library, ``lossless``
    where decoding returns the text (never for texts holding the marker character, which
    the format cannot tell from a blank).  The model file is read on the driver and shared.
    Columns of these names that are already there are replaced.
    """
    extra = ["n_pieces", "piece_ids", *["parity"] * verify, *["lossless"] * round_trip]
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    with open(model_path, "rb") as fh:
        model = docs.sparkSession.sparkContext.broadcast(fh.read())
    kinds = ["int", "array<int>", *["boolean"] * (verify + round_trip)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema] + [f"_{len(names) + i} {k}" for i, k in enumerate(kinds)])
    made = numbered.mapInArrow(_encode_batches(model, at(docs, text_col), threads, verify, round_trip), schema)
    stay = [i for i, n in enumerate(names) if n.lower() not in extra]
    return made.select(*[F.col(f"_{i}").alias(names[i]) for i in stay], *[F.col(f"_{len(names) + i}").alias(n) for i, n in enumerate(extra)])


def decoded(rows: DataFrame, ids_col: str = "piece_ids", model_path: str = PIECE_MODEL) -> DataFrame:
    """The rows with ``decoded``, the text of their ids; null ids decode to an empty text."""
    with open(model_path, "rb") as fh:
        model = rows.sparkSession.sparkContext.broadcast(fh.read())

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(codec(model.value).decode([np.array([] if i is None else i, dtype=np.int32) for i in ids]), dtype=object)

    return rows.withColumn("decoded", run(F.col(ids_col)))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, checked against the sentencepiece library and by decoding."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return encoded(docs, verify=True, round_trip=True).drop("text")


def parity(data: bytes, texts: list[str]) -> list[bool]:
    """Whether whole texts get the ids and the decoded text of the sentencepiece library."""
    import sentencepiece

    own, other = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    mine, theirs = own.encode(texts)[0], other.encode(texts)
    return [a.tolist() == b and x == y for a, b, x, y in zip(mine, theirs, own.decode(mine), other.decode(theirs))]
