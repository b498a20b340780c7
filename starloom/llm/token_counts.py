"""Token counts: batches of about equal bytes go to the tokenizer, and only lengths come back.

A text is cut where the tokenizer never looks across, so that a batch holds many short units and no
long one.  Each different unit of a batch is encoded once; its length is remembered by a 64-bit hash
while there is room.  The sum of the lengths of a text's units is the length of the text's encoding.

Where byte-level BPE may be cut: its pattern lets a match end with a character that is not white
space and go on with none, so a cut before ASCII white space behind such a character is safe.  In
units beyond ``LONG`` bytes, which have no such place, a cut is also safe behind an ASCII letter or
digit before another class of ASCII character (but ``|``, which stands in special tokens), and
behind a Chinese character before a Chinese stop or comma.  What is longer still is encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, hash_runs, map_batches, rows_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens that a text may have.
LIMIT = 512
#: Bytes of text cut and hashed at once, bytes given to the tokenizer at once, bytes from which a unit is cut again, and units whose lengths a worker remembers.
STEP, ENCODED, LONG, REMEMBERED = 4 << 20, 1 << 20, 1 << 15, 4_000_000

# Bytes of white space, of what other engines take for it, and the last two bytes of white space beyond ASCII.
SPACE, DOUBTFUL = [9, 10, 11, 12, 13, 32], [28, 29, 30, 31]
SPACE_TAILS = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, b) for b in range(0x80, 0x8B)), (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]
STOPS = [b"\xe3\x80\x82", b"\xe3\x80\x81", b"\xef\xbc\x8c"]

#: Classes of bytes: 0 white space, 1 others, 2 digits, 3 letters, 4 beyond ASCII, 5 what no cut stands before.
KIND = np.full(256, 1, np.uint8)
KIND[SPACE] = 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 3
KIND[128:] = 4
KIND[[*DOUBTFUL, ord("|")]] = 5


def _cuttable(path: str) -> bool:
    """Whether the file is of a byte-level BPE that can be cut as told above."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and all("!" <= c <= "~" and not c.isdigit() for c in t["content"]) and "|" in t["content"] for t in spec.get("added_tokens", []))
    return plain and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


class Lengths:
    """Lengths of texts in tokens."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.cuttable = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.cuttable = _cuttable(path)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def encoded(self, units: list[bytes]) -> list[int]:
        """Each unit's length; units go to the tokenizer some bytes at a time."""
        out: list[int] = []
        batch, size = [], 0
        for unit in units:
            batch.append(unit.decode())
            size += len(unit)
            if size >= ENCODED:
                out += self._encode(batch)
                batch, size = [], 0
        return out + (self._encode(batch) if batch else [])

    def of(self, texts: list[bytes]) -> np.ndarray:
        if not self.cuttable:
            return np.array(self.encoded(texts), np.int64)
        data = b"".join(texts)
        begin = np.cumsum([0] + [len(t) for t in texts])
        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        start = np.flatnonzero(_starts(raw[: len(data)], begin))
        size = np.diff(start, append=len(data))
        uniq, where, back = np.unique(hash_runs(raw, start, size), return_index=True, return_inverse=True)
        if len(self.hash) + len(uniq) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hash, uniq)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == uniq[known]
        new = np.flatnonzero(~known)
        found = self.encoded([data[s : s + n] for s, n in zip(start[where[new]].tolist(), size[where[new]].tolist(), strict=True)])
        lengths = np.zeros(len(uniq), np.int64)
        lengths[known], lengths[new] = self.length[at[known]], found
        self.hash, self.length = np.insert(self.hash, at[new], uniq[new]), np.insert(self.length, at[new], found)
        sums = np.concatenate([[0], np.cumsum(lengths[back])])
        return np.diff(sums[np.searchsorted(start, begin)])


def _starts(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where units start: at each text that is not empty, and at the safe places inside."""
    first = np.zeros(len(raw), bool)
    if not len(raw):
        return first
    kind = KIND[raw]
    first[1:] = (kind[1:] == 0) & (kind[:-1] > 0) & ~np.isin(raw[:-1], DOUBTFUL)
    doubt = np.flatnonzero(first & (np.roll(kind, 1) == 4))
    for a, b in SPACE_TAILS:
        first[doubt[(raw[doubt - 2] == a) & (raw[doubt - 1] == b)]] = False
    first[begin[:-1][begin[:-1] < len(raw)]] = True
    start = np.flatnonzero(first)
    size = np.diff(start, append=len(raw))
    for s, n in zip(start[size > LONG].tolist(), size[size > LONG].tolist(), strict=True):
        part, k = raw[s : s + n], kind[s : s + n]
        soft = np.zeros(n, bool)
        soft[1:] = (k[1:] != k[:-1]) & ((k[:-1] == 2) | (k[:-1] == 3)) & (k[1:] >= 1) & (k[1:] <= 3)
        for stop in STOPS:
            there = np.flatnonzero((part[3:-2] == stop[0]) & (part[4:-1] == stop[1]) & (part[5:] == stop[2])) + 3
            soft[there[(part[there - 3] >= 0xE5) & (part[there - 3] <= 0xE8)]] = True
        first[s : s + n] |= soft
    return first


def lengths_of_worker(path: str) -> Lengths:
    """One for each Python worker and file: its next task finds the units remembered."""
    kept = vars(public_tokenizers).setdefault("_lengths_of_worker", {})
    return kept.get(path) or kept.setdefault(path, Lengths(path))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``tokenizer`` is the path, on every machine, of a file for the library tokenizers (.json) or
    sentencepiece (.model).  No begin, end or other special token is added; special strings in a text
    count as the library takes them; nothing is truncated or padded.  A null or empty text has 0
    bytes and 0 tokens.  Every row gives one row, repeated ids and null ids too.  Other columns are
    not looked at, whatever their names.  An empty table gives an empty table.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        lengths = lengths_of_worker(tokenizer)
        for batch, texts in rows_of(batches, "text", STEP):
            texts = [t or b"" for t in texts]
            counts = lengths.of(texts)
            arrays = [column(batch, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(rows, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
