"""Sequence packing for instruction data by dot-product vector bin packing.

An example is a vector of demands: tokens, segments (one a piece) and
loss-bearing tokens.  A sequence holds limits on all three.  Pieces of a whole
sequence's length are sequences of their own.  The rest is placed sequence by
sequence: of the pieces that fit, the one with the largest dot product of demand
and what is left of the limits (both as shares of the limits) goes in; pieces are
classed by demand, so a step looks at the classes, not the pieces.  When nothing
fits and segments are left, the largest piece is cut to fill the gap.  The last,
partly filled sequences of a block are cut into powers of two, which need no
padding, when ``split_tail`` is set.

A block is the rows of one Arrow batch of a scan task, so blocks are bounded, no
row is shuffled, a lost task is repeated alone, and sequence ids (task number and
counter) do not depend on others.

Defined results: null text counts as empty (its only id is the end id); null
doc_id and repeated rows are packed like others; extra columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: split of byte-level vocabularies of this kind (fixed value)
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: visible bytes stand for themselves, the
    others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """ids of whole texts, as a vocabulary file of the tokenizers library gives them.

    A plain byte-level BPE whose merges are in the order of their ids is run by
    tiktoken, which gives the same ids several times faster and remembers nothing
    from text to text; texts that hold the string of a special token, and other
    kinds of vocabulary, are encoded by the tokenizers library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranks(spec)

    def _ranks(self, spec):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
                 and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges")))
        if not plain:
            return None
        of, vocab = byte_letters(), model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        special = set(self.special)
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
        if merged != sorted(merged) or len(ranks) != 256 + len(merged):
            return None
        import tiktoken
        return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """uint32 ids, little-endian."""
        if self.fast is None or any(x in text for x in self.special):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batch_ids(texts: list[str], path: str) -> list[bytes]:
    """ids of each text as uint32 bytes, equal to encoding each text whole."""
    return list(map(encoder(path).ids, texts))


def place(tokens, loss, limits, split_tail: bool = True):
    """Pieces (item, start, length, sequence, offset) of items with the given demands.

    tokens: ids of each item; loss: where each item's loss-bearing ids start (its
    loss-bearing ids are the rest); limits: (tokens, segments, loss-bearing ids)."""
    max_t, max_s, max_l = limits
    pieces, seq = [], 0
    classes: dict[tuple[int, int], list] = {}
    demand = lambda start, n, first: (n, max(0, start + n - max(first, start)))
    full = min(max_t, max_l)
    for i, (n, first) in enumerate(zip(tokens, loss)):
        start = 0
        while n - start >= full:
            pieces.append((i, start, full, seq, 0))
            start, seq = start + full, seq + 1
        if n > start:
            classes.setdefault(demand(start, n - start, first), []).append((i, start, n - start))
    # tables over the classes seen; a cut adds its rest as a new class
    t = np.array([k[0] for k in classes], dtype=np.int64)
    l = np.array([k[1] for k in classes], dtype=np.int64)  # noqa: E741
    stacks = list(classes.values())
    where = {k: j for j, k in enumerate(classes)}
    count = np.array([len(x) for x in stacks], dtype=np.int64)
    left = int(count.sum())
    while left:
        rt, rs, rl, offset, opened = max_t, max_s, max_l, 0, []
        while left and rt > 0 and rs > 0:
            fits = (count > 0) & (t <= rt) & (l <= rl)
            if fits.any():
                dot = t * (rt / max_t ** 2) + rs / max_s ** 2 + l * (rl / max_l ** 2)
                j = int(np.argmax(np.where(fits, dot, -1.0)))
                item, start, n = stacks[j].pop()
                count[j] -= 1
                left -= 1
                used = n
            else:
                j = int(np.argmax(np.where(count > 0, t, -1)))
                item, start, n = stacks[j][-1]
                first = loss[item]
                used = min(rt, n, max(0, first - start) + rl)
                if used <= 0:
                    break
                stacks[j].pop()
                count[j] -= 1
                rest = (item, start + used, n - used)
                key = demand(rest[1], rest[2], first)
                if key in where:
                    stacks[where[key]].append(rest)
                    count[where[key]] += 1
                else:
                    where[key] = len(stacks)
                    stacks.append([rest])
                    t, l, count = np.append(t, key[0]), np.append(l, key[1]), np.append(count, 1)  # noqa: E741
            opened.append((item, start, used))
            d = demand(start, used, loss[item])
            rt, rs, rl, offset = rt - d[0], rs - 1, rl - d[1], offset + used
        if not opened:
            raise ValueError("limits too small for any piece")
        size = sum(x[2] for x in opened)
        ends = [size] if left or not split_tail or size == max_t else _powers(size)
        at = k = 0
        for item, start, n in opened:
            while n:
                step = min(n, ends[k] - at)
                pieces.append((item, start, step, seq, at))
                start, n, at = start + step, n - step, at + step
                if at == ends[k]:
                    at, k, seq = 0, k + 1, seq + 1
    return pieces, seq


def _powers(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, max_segments: int = 512,
                   max_loss: int | None = None, end_id: int = 0, prompt_col: str | None = None, split_tail: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    tokenizer: name of a public vocabulary file, or a path that all executors
    have; prompt_col: number of leading ids without loss (default none)."""
    limits = (max_tokens, max_segments, max_loss or max_tokens)

    def pack(batches):
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers
            path = public_tokenizers.path(tokenizer)
        task, seq0 = TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for b in batches:
            doc_ids, texts, prompts = (b.column(i).to_pylist() for i in range(3))
            ids = [x + end for x in batch_ids(texts, path)]
            sizes = [len(x) // 4 for x in ids]
            loss = [min(max(p, 0), n) for p, n in zip(prompts, sizes)]
            pieces, used = place(sizes, loss, limits, split_tail)
            rows = [(doc_ids[i], s, n, zlib.crc32(ids[i][4 * s:4 * (s + n)]), sizes[i], (task << 33) + seq0 + q, o,
                     max(0, s + n - max(loss[i], s))) for i, s, n, q, o in pieces]
            seq0 += used
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                    "sequence_id", "offset", "loss_tokens"])
        give_back()

    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0).cast("long")
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"),
                    prompt.alias("prompt"))
    return x.mapInArrow(pack, SCHEMA)
