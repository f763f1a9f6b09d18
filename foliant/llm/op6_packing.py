"""Packing: Karmarkar-Karp multiway differencing into windows of nearly equal length.

A document is tokenised once, cut into full windows and a tail, and the tail into two items at most. Items meet in groups
of bounded size, dealt by a hash. In a group, Karmarkar-Karp differencing starts with one partial partition per item
and always merges the two with the widest imbalance, longest window against shortest. If a window then exceeds the
capacity, the number of windows rises and the group is packed again. A group whose items fit few windows ends with windows
that are nearly equal, so all of them are padded by little.

Defined cases: a null or empty text is the end token alone; a null id counts like any other; repeated rows are packed as documents of
their own and dealt apart; texts of any length are cut into as many windows as they fill; equal lengths are placed by id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import cached, stash, table

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, sequence_id long, offset long"
_KINDS = {"long": pa.int64(), "int": pa.int32()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(", ")])


#: A part that is one run of Latin letters, then a run of ASCII marks: two units of the tokenizer's own split.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([-,.;:!?%&$#*|<>()\"/=+]*)")
#: White space beside a space, or at an end.
_UNEVEN = re.compile(r"\s |\s\Z| \s|\A\s")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of whole texts as bytes of little-endian unsigned 32-bit numbers.

    A text is cut before each single space that has no white space beside it; the tokenizer never joins across such a
    place, so the ids of each part are looked up, and the tokenizer only runs over parts not seen lately.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}  # of a part without its leading space
        self.units: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unit(self, text: str) -> bytes:
        got = self.units.get(text)
        if got is None:
            if len(self.units) >= self.most:
                self.units.clear()
            letters = self.letters
            tokens = self.model.tokenize("".join([letters[b] for b in text.encode()]))
            got = self.units[text] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return got

    def part(self, text: str) -> bytes:
        plain = _PLAIN.fullmatch(text)
        if plain is None:
            lines = text.split("\n")  # single line ends between plain parts are units of their own
            if len(lines) > 1 and all(map(_PLAIN.fullmatch, lines)):
                return self.unit("\n").join(map(self.part, lines))
            return self.whole(text)
        if "<|" in text:
            return self.whole(text)
        return self.unit(plain[1]) + (self.unit(plain[2]) if plain[2] else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        out, known = [], self.known
        for text in texts:
            if _UNEVEN.search(text):
                out.append(b"".join(self.uneven(text)))
                continue
            first, *parts = text.split(" ")
            got = list(map(known.get, parts))
            if None in got:
                if len(known) >= self.most:
                    known.clear()
                for i, ids in enumerate(got):
                    if ids is None:
                        got[i] = known.get(parts[i]) or known.setdefault(parts[i], self.part(" " + parts[i]))
            out.append(self.part(first) + b"".join(got))
        return out

    @staticmethod
    def of(path: str, most: int) -> Encoder:
        """The encoder of this Python worker, which keeps what earlier tasks looked up."""
        return cached(("encoder", path, most), lambda: Encoder(path, most))

    def uneven(self, text: str) -> list[bytes]:
        """A part that begins or ends with white space stays with its neighbours."""
        first, *parts = text.split(" ")
        merged = [first]
        for p in parts:
            if p and not p[0].isspace() and merged[-1] and not merged[-1][-1].isspace():
                merged.append(" " + p)
            else:
                merged[-1] += " " + p
        return [self.part(p) for p in merged]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full windows, then a tail in at most two items."""
    out = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at, rest = len(out) * capacity, n - len(out) * capacity
    if rest > capacity // 2:
        out.append((at, capacity // 2))
        at, rest = at + capacity // 2, rest - capacity // 2
    return out + [(at, rest)] * (rest > 0)


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window of each item after Karmarkar-Karp differencing into k windows."""
    parts, heap = {}, []
    for i, s in enumerate(sizes):  # sums of the windows in rising order, and each item's window
        totals = np.zeros(k, np.int64)
        totals[-1] = s
        parts[i] = (totals, np.array([i]), np.array([k - 1]))
        heap.append((-s, i))
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        a, ai, aw = parts.pop(heapq.heappop(heap)[1])
        b, bi, bw = parts.pop(heapq.heappop(heap)[1])
        totals = a + b[::-1]  # the longest of one on the shortest of the other
        order = np.argsort(totals, kind="stable")
        rank = np.empty(k, np.int64)
        rank[order] = np.arange(k)
        parts[new] = (totals[order], np.concatenate((ai, bi)), np.concatenate((rank[aw], rank[k - 1 - bw])))
        heapq.heappush(heap, (int(totals[order[0]] - totals[order[-1]]), new))
        new += 1
    window = np.zeros(len(sizes), np.int64)
    for _, items, at in parts.values():
        window[items] = at
    return window


def pack_group(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each item; no window exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, k)
        most = int(np.bincount(window, weights=sizes, minlength=k).max()) if sizes else 0
        if most <= capacity:
            return window
        k += max(1, k // 64)


def karmarkar_karp_packing(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, group: int = 1500, lookups: int = 400_000) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): where it lies in its document and in which sequence.

    tokenizer: path of a tokenizer file on every machine. group: about how many items meet in one task's group.
    lookups: parts and units of texts that a worker keeps with their ids, some 100 bytes each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def pieces(batches):
        encoder, end = Encoder.of(tokenizer, lookups), np.zeros(1, "<u4").tobytes()
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * 1e6 / max(batch.nbytes, 1)) + 1))
            for first in range(0, batch.num_rows, step):
                part, rows = batch.slice(first, step), []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, got in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    got += end
                    for at, n in cuts(len(got) // 4, capacity):
                        rows.append((doc_id, at, n, crc32(got[4 * at : 4 * (at + n)]), len(got) // 4))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=arrow_schema(PIECE))
        pa.default_memory_pool().release_unused()

    cut = stash(docs.mapInArrow(pieces, PIECE))
    groups = max(1, -(-cut.stashed_rows // group))
    row = F.monotonically_increasing_id()  # of written rows: rows that are equal are dealt apart
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", row), F.lit(groups)).cast("int"))

    def place(got: pa.Table) -> pa.Table:
        got = got.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        sizes = got.column("length").to_numpy()
        full = sizes >= capacity
        window = np.arange(len(sizes))
        window[~full] = full.sum() + pack_group(sizes[~full].tolist(), capacity)
        order = np.argsort(window, kind="stable")
        ordered, by_window = sizes[order], window[order]
        before = np.cumsum(ordered) - ordered
        begins = np.concatenate(([True], by_window[1:] != by_window[:-1]))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(begins, before, 0))
        number = got.column("grp").to_numpy().astype(np.int64) << 32
        columns = [got.column(f.split()[0]) for f in PIECE.split(", ")]
        return pa.Table.from_arrays([*columns, pa.array(number + window), pa.array(offset)], schema=arrow_schema(PLACED))

    return dealt.groupBy("grp").applyInArrow(place, PLACED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return karmarkar_karp_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
