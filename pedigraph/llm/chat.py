"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole, ``<turn>role<text>text</turn>`` and a line feed per
turn, and encoded once with offsets.  The three markers are tokens of their own, so no
token crosses from a marker into a text.  Marker strings inside roles and texts are
escaped by a back slash in a way that can be undone.  The spans of the assistant texts
are intersected with the token spans by binary search; the tokens inside carry the loss.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.llm.common import pick

BYTE_BPE = os.environ.get("PEDIGRAPH_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
MARKS = ("<turn>", "<text>", "</turn>")
_MARK = re.compile(r"<(turn>|text>|/turn>)")
_TURN = re.compile(r"<turn>(.*?)<text>(.*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_CHUNK = 2_000_000


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of the texts to train on."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{MARKS[0]}{escape(role or '')}{MARKS[1]}", escape(text or "")
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{MARKS[2]}\n"]
        at += len(head) + len(body) + len(MARKS[2]) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a formatted conversation."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


@functools.lru_cache(maxsize=2)
def tokenizer(model_json: str):
    """A byte-level tokenizer with the three markers as tokens; other special strings are ordinary text."""
    from tokenizers import AddedToken, Tokenizer, processors

    made = Tokenizer.from_str(model_json)
    made.encode_special_tokens = True
    made.add_tokens([AddedToken(m, normalized=False, special=False) for m in MARKS])
    made.post_processor = processors.ByteLevel(trim_offsets=False)
    made.no_padding()
    made.no_truncation()
    return made


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token whose span meets a trained span; both lists are sorted."""
    mask = np.zeros(len(offsets), dtype=np.int8)
    if len(offsets) and spans:
        wanted = np.array(spans, dtype=np.int64)
        first = np.searchsorted(offsets[:, 1], wanted[:, 0], side="right")
        last = np.searchsorted(offsets[:, 0], wanted[:, 1], side="left")
        for lo, hi in zip(first, last):
            mask[lo:hi] = 1
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped: one piece for each run of trained tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    return "".join(unescape(formatted[starts[lo]:ends[hi - 1]]) for lo, hi in zip(edge[::2], edge[1::2]))


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


OUTPUT = ("conv_id {id}, n_turns long, formatted string, input_ids array<int>, starts array<int>, ends array<int>, "
          "loss_mask array<tinyint>")


def _encode_batches(model, trained: str) -> Callable:
    """A mapInArrow body: (conv_id, turns) -> formatted text, ids, offsets and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizer(model.value)
        for batch in batches:
            turns, ids = batch.column(1), batch.column(0)
            roles, texts = turns.flatten().field("role").to_pylist(), turns.flatten().field("text").to_pylist()
            cut = np.concatenate(([0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
            i = 0
            while i < batch.num_rows:
                done, begin, size = [], i, 0
                while i < batch.num_rows and size < _CHUNK:
                    done.append(render(list(zip(roles[cut[i]:cut[i + 1]], texts[cut[i]:cut[i + 1]])), trained))
                    size += len(done[-1][0])
                    i += 1
                encoded = tok.encode_batch([f for f, _ in done], add_special_tokens=False)
                offsets = [np.array(e.offsets, dtype=np.int32).reshape(-1, 2) for e in encoded]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, i - begin), pa.array(cut[begin + 1:i + 1] - cut[begin:i], pa.int64()), pa.array([f for f, _ in done], pa.string()),
                     _lists([np.array(e.ids, dtype=np.int32) for e in encoded], pa.int32()),
                     _lists([o[:, 0] for o in offsets], pa.int32()), _lists([o[:, 1] for o in offsets], pa.int32()),
                     _lists([loss_mask(o, spans) for o, (_, spans) in zip(offsets, done)], pa.int8())],
                    names=["conv_id", "n_turns", "formatted", "input_ids", "starts", "ends", "loss_mask"])

    return run


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what the formatted conversations and masks say."""
    for batch in batches:
        rows = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens")}
        lists = {n: batch.column(n) for n in ("starts", "ends", "loss_mask")}
        for i, formatted in enumerate(batch.column("formatted").to_pylist()):
            starts, ends, mask = (v[i].values.to_numpy() for v in lists.values())
            turns, trained = parse(formatted), masked_text(formatted, starts, ends, mask)
            found = "".join(f"{role}\n{text}\n" for role, text in turns)
            for name, value in zip(rows, (len(turns), _sha(found), len(trained), _sha(trained), len(formatted), len(mask), int(mask.sum()))):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, pa.string() if n.endswith("256") else pa.int64()) for n, v in rows.items())],
                                         names=["conv_id", *rows])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def gathered(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns by turn number (null first), ties by role, then text."""
    rows = pick(turns, "conv_id", "turn", "role", "text")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def format_chats(turns: DataFrame, trained: str = "assistant", model_path: str = BYTE_BPE) -> DataFrame:
    """One row per conversation: formatted text, token ids, token spans (code points) and loss mask.

    Null roles and texts are empty; rows with a null conv_id are one conversation; repeated
    rows are repeated turns.  A conversation is one output row and so has to fit in a task.
    An empty table gives an empty result.
    """
    grouped = gathered(turns)
    return grouped.mapInArrow(_encode_batches(_model(turns.sparkSession, model_path), trained), OUTPUT.format(id=grouped.schema["conv_id"].dataType.simpleString()))


def _model(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as fh:
        return spark.sparkContext.broadcast(fh.read())


def chat_digests(turns: DataFrame, trained: str = "assistant", model_path: str = BYTE_BPE) -> DataFrame:
    """format_chats and, in the same pass, what reads back from its output."""
    grouped = gathered(turns)
    encode = _encode_batches(_model(turns.sparkSession, model_path), trained)
    schema = (f"conv_id {grouped.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, n_tokens long, n_loss_tokens long")
    return grouped.mapInArrow(lambda batches: _read_back(encode(batches)), schema)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, whose texts hold marker strings."""
    turns = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(turns.union(probe))
