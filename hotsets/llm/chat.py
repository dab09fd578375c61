"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import map_batches, quoted

#: the mark around roles and texts; the vocabulary reads it as one token of its own, so no token
#: reaches from a mark into a text
MARK = "<|endoftext|>"
#: strings that chat templates give a meaning to; none is left whole inside a text
CONTROL = [MARK, "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPED = re.compile("|".join(re.escape(c) for c in ["\\", *CONTROL]))
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Break up control strings by a backslash after their first character; double backslashes."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The conversation as one string, and (start, end, turn) of every text in it."""
    out, spans, at = [], [], 0
    for n, (role, text) in enumerate(turns):
        head, body = MARK + escape(role) + MARK, escape(text)
        out += [head, body]
        spans.append((at + len(head), at + len(head) + len(body), n))
        at += len(head) + len(body)
    out.append(MARK)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    parts = formatted.split(MARK)[1:-1]
    return [(unescape(r), unescape(t)) for r, t in zip(parts[::2], parts[1::2])]


def token_bounds(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters owned by each token: from where the tokens before it have ended to its own end.

    Byte-level tokens may share a character or leave a blank out of their offsets; so every
    character belongs to the first token that ends with or after it.
    """
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    return np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)


def masked_spans(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which tokens carry loss, and (start, end, turn) of the characters that they cover.

    ``spans`` are sorted, as are the tokens: the first and last token of a span are found by
    binary search and cut to the span.
    """
    mask, out = np.zeros(len(starts), bool), []
    for a, b, turn in spans:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if a < b and lo < hi:
            mask[lo:hi] = ends[lo:hi] > starts[lo:hi]
            out.append((max(a, int(starts[lo])), min(b, int(ends[hi - 1])), turn))
    return mask, out


def format_conversations(rows: DataFrame, tokenizer_json: str, loss_role: str = "assistant", conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``formatted``, ``ids``, ``loss_mask`` (per token), ``loss_spans`` (characters of
    ``formatted`` under the mask, with their turn's number), one row per conversation.

    Rows are put in order by turn, then role and text (repeated turns stay, side by side); NULL
    text and role count as empty.  The whole conversation is encoded once, so it must fit a
    task.  A turn without text has no span.  Rows of a NULL conversation id are one conversation.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    turn = F.struct(quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"))
    whole = rows.select(quoted(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    vocabulary = rows.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of fixed size
    kind = whole.schema["conv_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("turn", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary.value)
        for b in batches:
            made = [[(t["role"], t["text"]) for t in turns.as_py()] for turns in b.column("turns")]
            rendered = [render(turns) for turns in made]
            ids, masks, spans = [], [], []
            for (formatted, texts), turns, e in zip(rendered, made, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                starts, ends = token_bounds(offsets[:, 1])
                mask, covered = masked_spans(starts, ends, [s for s in texts if turns[s[2]][0] == loss_role])
                ids.append(e.ids)
                masks.append(mask.tolist())
                spans.append([{"a": x, "b": y, "turn": n} for x, y, n in covered])
            yield pa.record_batch([b.column("conv_id"), pa.array([r[0] for r in rendered], pa.string()), pa.array(ids, pa.list_(pa.int32())),
                                   pa.array(masks, pa.list_(pa.bool_())), pa.array(spans, spans_type)],
                                  ["conv_id", "formatted", "ids", "loss_mask", "loss_spans"])

    return map_batches(whole, run, f"conv_id {kind}, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<a:int,b:int,turn:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read from the output alone: turns parsed from the string, loss text from the mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for whole, spans in zip(b.column("formatted"), b.column("loss_spans")):
                whole = whole.as_py()
                turns = parse(whole)
                loss = "".join(unescape(whole[s["a"]:s["b"]]) for s in spans.as_py())
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest())
                out["formatted_chars"].append(len(whole))
            yield pa.record_batch([b.column("conv_id")] + [pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items()], ["conv_id", *out])

    return map_batches(formatted.select("conv_id", "formatted", "loss_spans"), run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
