"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Texts are tokenised once; only (document, piece, length, checksum) goes on.  Pieces are dealt at
random into groups of about ``GROUP`` pieces.  Each group is packed best-fit decreasing; then
documents move and are exchanged one for one and two for one between underfull bins whenever that
raises the sum of squared fills, until nothing does, and empty bins go.  A group wastes less than
a bin or so of about its thousands.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hash_runs, map_batches, rows_of

#: Tokens of a sequence, pieces of a group, and units whose ids a worker remembers (some 40 bytes each).
CAPACITY, GROUP, REMEMBERED = 2048, 4000, 2_000_000
#: Bytes of text tokenised at once.
STEP = 6 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.ones(256, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*b".,;:!?"]] = 2
KIND[97:123] = 3
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Token ids of texts, as arrays.

    The tokenizer drops white space and looks at nothing across it, so what stands between ASCII
    white space is a unit by itself; A-Z count as a-z, and a closing mark between an ASCII letter
    and white space is a unit too.  Each unit, known by a 64-bit hash, is tokenised once and
    remembered.  Units of letters only are tokenised many at a time: each ends with the one token
    that ends a word.  Texts that may hold a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _encode(self, units: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(units)
        plain, rest = [], []
        for i, text in enumerate([u.decode() for u in units]):
            # the tokenizer lower-cases a final capital sigma like any other
            (plain if text.isalpha() and "\u03a3" not in text and text.lower().isalpha() else rest).append((i, text))
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = np.array(self.tokenizer.encode(" ".join([t for _, t in some]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                rest += some
                continue
            for (i, _), a, b in zip(some, [0, *cuts.tolist()], cuts.tolist()):  # noqa: B905
                out[i] = ids[a:b]
        for (i, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        ids = self._encode(units)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else self.pool[:0]
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        to = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, to, hashes)
        self.at = np.insert(self.at, to, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, to, sizes)
        self.used += len(flat)

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        whole = [b"<|" in (t or b"") for t in texts]
        given = texts
        texts = [b"" if w else t or b"" for t, w in zip(texts, whole, strict=True)]
        raw = LOWER[np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        kind = KIND[raw]  # 0 white space, 1 others, 2 closing marks, 3 letters
        solid = kind > 0
        mark = np.flatnonzero(kind == 2)
        mark = mark[(mark > 0) & (kind[mark - 1] == 3) & (kind[mark + 1] == 0)]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        first[mark] = True
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[mark - 1] = True
        start = np.flatnonzero(first)
        length = np.flatnonzero(last) + 1 - start
        unit = np.searchsorted(start, begin)
        uniq, where, back = np.unique(hash_runs(raw, start, length), return_index=True, return_inverse=True)
        if len(self.hash) + len(uniq) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(self._find(uniq) < 0)
        data = raw.tobytes()
        self._learn(uniq[new], [data[s : s + n] for s, n in zip(start[where[new]].tolist(), length[where[new]].tolist(), strict=True)])
        entry = self._find(uniq)[back]
        sizes = self.size[entry]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.at[entry] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[unit]
        return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32) if w else ids[bounds[d] : bounds[d + 1]] for d, (t, w) in enumerate(zip(given, whole, strict=True))]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)


def ids_of_worker(path: str) -> Ids:
    """One for each Python worker and file: its next task finds the words remembered."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_ids_of_worker", {})
    return kept.get(path) or kept.setdefault(path, Ids(path))


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an id 0, cut after every ``capacity`` ids."""
    kind = df.schema[id_col].dataType.simpleString().replace("bigint", "long")

    def run(batches):
        ids = ids_of_worker(tokenizer)
        for batch, texts in rows_of(batches, "text", STEP):
            rows: list[tuple] = []
            of = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc, b in zip(of, ids.of(texts), strict=True):
                b = np.append(b.astype("<u4"), np.uint32(0)).tobytes()
                rows += [(doc, p, s // 4, min(len(b) - s, 4 * capacity) // 4, zlib.crc32(b[s : s + 4 * capacity])) for p, s in enumerate(range(0, len(b), 4 * capacity))]
            doc_id, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices, packed best-fit decreasing."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space, bin) in order
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([])
            space, b = capacity, len(bins) - 1
        else:
            space, b = room.pop(at)
        bins[b].append(i)
        if space > lengths[i]:
            insort(room, (space - lengths[i], b))
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves and exchanges between underfull bins; empty bins go.

    From the emptiest on, each bin gives to fuller ones: a piece moves, or one piece or two replace
    a smaller one.  Each step raises the sum, as the giver is the emptier.  A pass ends when no bin
    can give; passes end when one changes nothing, which comes as the sum grows with each step.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    kind = [tuple(sorted(lengths[i] for i in b)) for b in bins]
    vain: set[tuple] = set()  # kinds of bins that have nothing to exchange
    while True:
        open_bins, changed, at = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b]), False, 0
        while at < len(open_bins) - 1:
            giver = open_bins[at]
            step = None
            mine = kind[giver]
            for taker in reversed(open_bins[at + 1 :]):
                if (mine, kind[taker]) in vain:
                    continue
                if step := _exchange(bins[giver], bins[taker], lengths, capacity - fill[taker]):
                    break
                vain.add((mine, kind[taker]))
            if not step:
                at += 1
                continue
            changed = True
            for source, goal, some in ((giver, taker, step[0]), (taker, giver, step[1])):
                for i in some:
                    bins[source].remove(i)
                    bins[goal].append(i)
                    fill[source] -= lengths[i]
                    fill[goal] += lengths[i]
            for b in (giver, taker):
                kind[b] = tuple(sorted(lengths[i] for i in bins[b]))
            rest = [b for b in open_bins[at:] if 0 < fill[b] < capacity]
            open_bins[at:] = sorted(rest, key=lambda b: fill[b])
        if not changed:
            break
    return [b for b in bins if b]


def _exchange(giver: list[int], taker: list[int], lengths: list[int], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What goes to the taker and what comes back, so that the taker gains most and at most its room."""
    mine = sorted((lengths[i], i) for i in giver)
    at = bisect_right(mine, (room, len(lengths)))
    best, step = (mine[at - 1][0], ((mine[at - 1][1],), ())) if at else (0, None)
    many = np.array([n for n, _ in mine]) if len(giver) > 64 else None  # too many pairs to list: the best is looked up for each goal
    pairs = [((lengths[a] + lengths[b]), (a, b)) for x, a in enumerate(giver) for b in giver[x + 1 :]] if many is None else []
    offers = sorted([(n, (i,)) for n, i in mine] + pairs)
    for i in taker:
        if best == room:
            break
        at = bisect_right(offers, lengths[i] + room, key=lambda o: o[0])
        if at and (gain := offers[at - 1][0] - lengths[i]) > best:
            best, step = gain, (offers[at - 1][1], (i,))
        if many is not None and (two := _best_pair(many, lengths[i] + room)) and (gain := int(many[two[0]] + many[two[1]]) - lengths[i]) > best:
            best, step = gain, ((mine[two[0]][1], mine[two[1]][1]), (i,))
    return step


def _best_pair(ordered: np.ndarray, most: int) -> tuple[int, int] | None:
    """Places of two lengths, in order, whose sum is the greatest of at most ``most``."""
    other = np.searchsorted(ordered, most - ordered, side="right") - 1
    first = np.flatnonzero(other > np.arange(len(ordered)))
    if not len(first):
        return None
    x = first[np.argmax(ordered[first] + ordered[other[first]])]
    return int(x), int(other[x])


def pack_group(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Add sequence_id (from 0) and offset to the pieces of one group."""
    rows = rows.sort_values(["doc_id", "piece"]).reset_index(drop=True)
    lengths = rows["length"].tolist()
    sequence, offset = [0] * len(rows), [0] * len(rows)
    for s, members in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
        at = 0
        for i in members:
            sequence[i], offset[i] = s, at
            at += lengths[i]
    return rows.assign(sequence_id=sequence, offset=offset)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    A null or empty text is one piece of the single id 0.  Repeated rows are packed each; rows that
    share an id, equal or not, are told apart by their places alone, as all their pieces carry the
    same id.  Pieces of equal length are taken in order of id and piece.  An empty table gives an
    empty table.
    """
    pieces = checkpoint(token_pieces(df, id_col, text_col, tokenizer, capacity))
    groups = pieces.count() // group + 1
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("part")
    kind = pieces.schema["doc_id"].dataType.simpleString().replace("bigint", "long")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        out = pack_group(rows.drop(columns="part"), capacity)
        out["sequence_id"] += part << 32
        return out

    return pieces.withColumn("part", key).groupBy("part").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
