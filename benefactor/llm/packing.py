"""Best-fit packing of tokenized documents into sequences of a fixed length.

Every document's ids, then an end id, become pieces of at most `length` tokens: a document that
fits is one piece; a longer one is cut into full pieces, with the short rest first. Pieces are
dealt by a hash into groups of about `docs_per_group` documents; each group is packed by online
best-fit with a bounded number of open sequences, kept in a bitset over their free space. When
too many are open, the fullest is closed. A group is a stream: pieces arrive in the order of a
hash, and a buffer of `lookahead` pieces is placed at a time, the longest first. A task holds the
buffer and the open sequences, not the group.

Edge cases: a null or empty text is one piece, the end id alone; repeated rows are separate
pieces; an empty table gives no rows. Ids do not leave the scan: only their checksum and length.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefactor.llm.common import pick


@dataclass(frozen=True)
class PackingParams:
    tokenizer: str = "byte_bpe_50k.json"  # a path, or a name for public_tokenizers.path
    length: int = 2048
    end_id: int = 0
    open_bins: int = 128
    lookahead: int = 512  # pieces
    docs_per_group: int = 16_384


#: Characters on which the pre-token pattern here and the one inside the tokenizer surely agree.
_ODD = re.compile("[^\x00-\x7f¡-ɏ‐-‧]")
#: The published byte-level BPE pre-token pattern (fixed value).
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """The ids of a byte-level BPE tokenizer file, as little-endian bytes.

    If the file is plain byte-level BPE (no normalizer, the published pre-token pattern, merges in the order
    of their results' ids), its own vocabulary is run by tiktoken, whose merge loop is several times
    faster, on texts of plain characters. All other texts, and all texts of any other file, go to the tokenizers library.
    """

    def __init__(self, tokenizer: str):
        import json
        import os

        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer
        if not os.path.isfile(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self._fast = None
        if plain_byte_bpe(described):
            byte = _byte_alphabet()
            ranks = {bytes(byte[c] for c in token): n for token, n in described["model"]["vocab"].items() if token not in self._special}
            self._fast = tiktoken.Encoding("file", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._fast is None or any(s in text for s in self._special) or not text.isascii() and _ODD.search(text):
            return self.slow(text)
        return array("I", self._fast(text)).tobytes()


def plain_byte_bpe(described: dict) -> bool:
    """Whether a tokenizer file's own description is that of plain byte-level BPE, whose ids rank its merges."""
    model, pre = described.get("model", {}), described.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab", {})
    if model.get("type") != "BPE" or described.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        return False
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [vocabulary.get("".join(m), -1) for m in merges]
    return all(c in vocabulary for c in _byte_alphabet()) and made == sorted(set(made)) and bool(made) and made[0] >= 0


def _byte_alphabet() -> dict[str, int]:
    """The published printable stand-ins of byte-level BPE: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def shared_encoder(tokenizer: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(tokenizer)


class BestFit:
    """Online best-fit with at most `open_bins` open; `add` gives the bin's number and the offset."""

    def __init__(self, length: int, open_bins: int):
        self._length, self._most = length, open_bins
        self._free: list[list[int]] = [[] for _ in range(length + 1)]  # open bins by free space
        self._bits = 0  # bit f is set while some open bin has f free
        self._open = self.bins = self.closed_early = 0

    def add(self, size: int) -> tuple[int, int]:
        fitting = self._bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = self._free[room].pop()
            if not self._free[room]:
                self._bits &= ~(1 << room)
            self._open -= 1
        else:
            room, number = self._length, self.bins
            self.bins += 1
        left = room - size
        if left:
            if self._open >= self._most:
                fullest = (self._bits & -self._bits).bit_length() - 1
                self.closed_early += 1
                if left <= fullest:
                    return number, self._length - room  # it is the fullest itself
                self._free[fullest].pop()
                if not self._free[fullest]:
                    self._bits &= ~(1 << fullest)
                self._open -= 1
            self._free[left].append(number)
            self._bits |= 1 << left
            self._open += 1
        return number, self._length - room


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of `total` ids; only the first may be short."""
    if total <= length:
        return [(0, total)]
    first = total % length or length
    return [(0, first), *((s, length) for s in range(first, total, length))]


def tokenize_pieces(docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and `copy`, a number that tells repeated rows apart."""

    def run(batches):
        encoder = shared_encoder(params.tokenizer)
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        end = np.array([params.end_id], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encoder.encode(text) + end if text else end
                for k, (start, size) in enumerate(cut(len(ids) // 4, params.length)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    out.append((doc_id, k, start, size, crc, row))
                row += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, copy long")


def pack(docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    rows = pick(docs, "doc_id", "text")
    groups = max(1, -(-rows.count() // params.docs_per_group))
    pieces = tokenize_pieces(rows, params).withColumn("turn", F.xxhash64("doc_id", "piece", F.lit(5)))
    pieces = pieces.repartition(groups, "doc_id", "piece", "copy").sortWithinPartitions("turn", "doc_id", "piece", "copy").drop("turn")

    def buffers(batches):
        held = []
        for pdf in batches:
            held.append(pdf)
            whole = pd.concat(held)
            full = len(whole) // params.lookahead * params.lookahead
            for at in range(0, full, params.lookahead):
                yield whole.iloc[at : at + params.lookahead]
            held = [whole.iloc[full:]]
        if held and len(held[0]):
            yield held[0]

    def run(batches):
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        bins = BestFit(params.length, params.open_bins)
        for buffer in buffers(batches):
            group = buffer.sort_values("length", ascending=False, kind="stable")
            placed = [bins.add(n) for n in group["length"].tolist()]
            group["sequence_id"] = np.array([p[0] for p in placed], np.int64) + base
            group["offset"] = np.array([p[1] for p in placed], np.int64)
            yield group.drop(columns="copy").astype({"doc_id": "Int64"})

    return pieces.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
