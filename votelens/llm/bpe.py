"""Byte-level BPE as a monoid: texts are encoded in halves, and two encodings are joined by re-encoding a window at the seam.

A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair is the encoding of its own bytes: merges
that stay inside a pair happen in the same order with and without the rest of the text, so the first merge across a seam
would also happen when the pair stands alone. Therefore a seam is settled as soon as the pairs at both ends of the
re-encoded window are stable; otherwise the window grows on the side that is not. Decoding concatenates up the same tree.

Rows: a null text is empty and has no tokens; repeated rows give repeated results; columns other than the id and the text
are not read. A text of any length is held by one task only; its tokens never meet another text."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens.llm.common import batch_of, id_and_text, slices

#: Bytes that a leaf of the tree merges directly.
LEAF = 6
#: Tokens that a leaf of the decoding tree concatenates directly.
DECODE_LEAF = 64
#: Pieces, seams and short encodings that a task remembers, of each kind, before it forgets them all.
REMEMBERED = 150_000
#: Bytes of the longest piece or window that is remembered.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def split_pattern(pattern: str) -> str:
    """The pattern for Python's engine: white space there also holds four control characters that Unicode does not count."""
    space = r"\p{White_Space}"
    return pattern.replace(r"[^\s", rf"[^{space}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", space)


class Tree:
    """Encodes pieces of bytes; keeps what it has learnt about seams, leaves and windows."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.seams: dict[tuple[int, int], list[int]] = {}
        self.short: dict[bytes, list[int]] = {}
        self.joins = 0

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        ranks, n = self.ranks, len(piece)
        if n <= SHORT:
            parts = [piece[i:i + 1] for i in range(n)]
            get, none = ranks.get, 1 << 60
            near = [get(piece[i:i + 2], none) for i in range(n - 1)]
            while near:
                best = min(near)
                if best == none:
                    break
                i = near.index(best)
                parts[i] += parts.pop(i + 1)
                near.pop(i)
                if i:
                    near[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(near):
                    near[i] = get(parts[i] + parts[i + 1], none)
            return [ranks[p] for p in parts]
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = ends[i]
            if j < 0 or j >= n or ends[j] != to:
                continue
            ends[i], ends[j] = to, -1
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i:ends[to]])) is not None:
                    heapq.heappush(heap, (r, i, ends[to]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:ends[i]]])
            i = ends[i]
        return out

    def encoded(self, piece: bytes) -> list[int]:
        """:meth:`merge` of a leaf or a window, remembered if it is short. The list is shared: callers don't change it."""
        known = self.short.get(piece)
        if known is None:
            known = self.merge(piece)
            if len(piece) <= SHORT:
                if len(self.short) > REMEMBERED:
                    self.short.clear()
                self.short[piece] = known
        return known

    def seam(self, a: int, b: int) -> list[int]:
        """The encoding of two neighbouring tokens; they are stable if it is the two themselves."""
        known = self.seams.get((a, b))
        if known is None:
            if len(self.seams) > REMEMBERED:
                self.seams.clear()
            known = self.seams[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return known

    def is_stable(self, a: int, b: int) -> bool:
        return self.seam(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of both byte strings together."""
        if not left or not right:
            return left or right
        self.joins += 1
        a = b = 1
        window = self.seam(left[-1], right[0])
        if window == [left[-1], right[0]]:  # pairs inside a side are stable already
            return left + right
        while True:
            left_done = a >= len(left) or self.is_stable(left[-a - 1], window[0])
            right_done = b >= len(right) or self.is_stable(window[-1], right[b])
            if left_done and right_done:
                return left[:max(0, len(left) - a)] + window + right[b:]
            a, b = (a if left_done else 2 * a), (b if right_done else 2 * b)
            window = self.encoded(b"".join(map(self.tokens.__getitem__, left[-a:] + right[:b])))

    def encode(self, piece: bytes) -> list[int]:
        """Bottom-up over leaves, so the depth of the tree costs no recursion."""
        level = [self.encoded(piece[i:i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def decode(self, ids: list[int]) -> bytes:
        return concatenated([self.tokens[i] for i in ids])


def concatenated(tokens: list[bytes]) -> bytes:
    """Up the tree of decoding: leaves of a fixed number of tokens, then neighbours two by two."""
    level = [b"".join(tokens[i:i + DECODE_LEAF]) for i in range(0, len(tokens), DECODE_LEAF)]
    while len(level) > 1:
        level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else b""


class Pieces(dict):
    """Matches of the split pattern and their ids as little-endian bytes."""

    def __init__(self, tree: Tree):
        super().__init__()
        self.tree = tree

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        raw = piece.encode()
        whole = self.tree.ranks.get(raw)
        ids = [whole] if whole is not None else self.tree.encode(raw)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= SHORT:
            self[piece] = packed
        return packed


def _broadcast(df: DataFrame, ranks: dict[bytes, int]):
    """The vocabulary: a fixed file of a few MB, whatever the data."""
    return df.sparkSession.sparkContext.broadcast(ranks)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes got back from the ids)."""
    vocabulary, schema = _broadcast(docs, ranks), pa.schema([("ids", pa.binary()), ("decoded", pa.binary())])
    split = split_pattern(pattern)
    out = T.StructType([id_and_text(docs).schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(vocabulary.value)
        pieces, find = Pieces(tree), regex.compile(split).findall
        packed = {i.to_bytes(4, "little"): t for i, t in tree.tokens.items()}
        for batch in batches:
            for part in slices(batch):
                ids, texts = [], []
                for text in part.column("text").to_pylist():
                    code = b"".join(map(pieces.__getitem__, find(text)))
                    ids.append(code)
                    texts.append(concatenated([packed[code[i:i + 4]] for i in range(0, len(code), 4)]))
                got = batch_of(schema, ids, texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *got.columns], names=["doc_id", *schema.names])

    return id_and_text(docs).mapInArrow(run, out)


def op9_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Digests of the round trip."""
    return round_trip(docs, ranks, pattern).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
