"""Operator 3, edit-aware token counts.

A document's pre-tokens (the pieces that a byte-pair encoder never joins) stand in the leaves of a segment tree, blocks of
`BLOCK` with their characters and tokens; inner nodes sum their children. An edit (at, removed, inserted: code points)
walks down by characters to the pre-token that it touches, takes one more on the left as context, since a run of white
space looks ahead, and reads pre-tokens from there until one ends where an old one ended beyond the edit: splitting has
no memory, so all later ones stand. Only the pre-tokens read are encoded; their block and the sums on its path to the root
change. Edits apply one after the other, each to the text the last one left; what lies beyond the text is cut off there.

Trees are kept: kept() counts every text once and returns its leaves beside it, for a table to be written; edited() takes
rows of such a table with their edits, rebuilds the tree from the leaves without encoding anything, and returns the counts
before and after together with the new text and leaves, to be kept in their turn. So an edit to a counted corpus costs
what it touches, of the documents that the table of edits names.

Encoding: the vocabulary file is a parameter (ranks of byte pairs), read by the driver and sent to the executors; counts of
pre-tokens are remembered within a task.

Nulls and edges: a null text is an empty one, a null list of edits none; null fields of an edit are 0, 0 and "". Rows
with a null or repeated id are rows of their own. An empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scoped, slices, written

#: A published vocabulary's file of ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of that vocabulary's pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 64


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Counter(dict):
    """The tokens of each pre-token seen, forgotten when half a million are held."""

    def __init__(self, vocabulary: str | bytes):
        import tiktoken

        super().__init__()
        data = vocabulary if isinstance(vocabulary, bytes) else _file(vocabulary)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[piece] = n = len(self.encode(piece))
        return n


def split_counts(text: str, counter: Counter) -> np.ndarray:
    """Characters and tokens of each pre-token, as two rows."""
    pieces = counter.split.findall(text)
    return np.array([list(map(len, pieces)), list(map(counter.__getitem__, pieces))], np.uint32)


class Document:
    """A text with the segment tree of its pre-tokens. Blocks stay slices of an array until an edit touches them."""

    def __init__(self, text: str, counter: Counter, leaves: np.ndarray | None = None):
        self.text, self.counter, self.encoded = text, counter, 0
        self._build(split_counts(text, counter) if leaves is None else leaves)

    def _build(self, leaves: np.ndarray) -> None:
        self.array, n = leaves, leaves.shape[1]
        many = max(1, -(-n // BLOCK))
        self.blocks: list[list[tuple[int, int]] | None] = [None] * many
        self.width = 1
        while self.width < many:
            self.width *= 2
        sums = np.add.reduceat(leaves.astype(np.int64), np.arange(0, n, BLOCK), axis=1) if n else np.zeros((2, 1), np.int64)
        self.chars, self.tokens = ([0] * self.width + x + [0] * (self.width - many) for x in sums.tolist())
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def _block(self, i: int) -> list[tuple[int, int]]:
        if self.blocks[i] is None:
            self.blocks[i] = list(zip(*self.array[:, i * BLOCK : (i + 1) * BLOCK].tolist()))
        return self.blocks[i]

    def _set(self, i: int, block: list[tuple[int, int]]) -> None:
        self.blocks[i] = block
        n = self.width + i
        self.chars[n], self.tokens[n] = sum(c for c, _ in block), sum(t for _, t in block)
        while n > 1:
            n //= 2
            self.chars[n], self.tokens[n] = self.chars[2 * n] + self.chars[2 * n + 1], self.tokens[2 * n] + self.tokens[2 * n + 1]

    def leaves(self) -> np.ndarray:
        """Characters and tokens of each pre-token, as two rows."""
        parts = [self.array[:, i * BLOCK : (i + 1) * BLOCK] if b is None else np.array(b, np.uint32).reshape(-1, 2).T for i, b in enumerate(self.blocks)]
        return np.concatenate(parts, axis=1)

    def pre_tokens(self) -> int:
        n = self.array.shape[1]
        return sum(min(BLOCK, n - i * BLOCK) if b is None else len(b) for i, b in enumerate(self.blocks))

    def _find(self, at: int) -> tuple[int, int]:
        """The block of the first pre-token that ends at or after a character, and where the block begins."""
        n, start = 1, 0
        while n < self.width:
            n *= 2
            if self.chars[n] and start + self.chars[n] >= at or not self.chars[n + 1]:
                continue
            start += self.chars[n]
            n += 1
        return n - self.width, start

    def edit(self, at: int, removed: int, inserted: str) -> None:
        old = self.text
        at = min(max(at, 0), len(old))
        removed = min(max(removed, 0), len(old) - at)
        self.text = text = old[:at] + inserted + old[at + removed :]
        shift, end = len(inserted) - removed, at + removed
        b, start = self._find(at)
        # One pre-token of context: from the block before if need be.
        first, from_ = 0, start
        block = self._block(b)
        while first < len(block) and from_ + block[first][0] < at:
            from_ += block[first][0]
            first += 1
        if first:
            first -= 1
            from_ -= block[first][0]
        else:
            p = b - 1
            while p >= 0 and not self._block(p):
                p -= 1
            if p >= 0:
                b, block = p, self._block(p)
                first = len(block) - 1
                start -= sum(c for c, _ in block)
                from_ -= block[first][0]
        # Read on until a new end meets an old one beyond the edit.
        kept, fresh = block[:first], []
        old_b, old_i, old_end = b, first, from_
        new_end = from_
        for m in self.counter.split.finditer(text, from_):
            if new_end - shift >= end and new_end > from_:
                while old_end < new_end - shift:
                    if old_i >= len(self._block(old_b)):
                        old_b, old_i = old_b + 1, 0
                        continue
                    old_end += self._block(old_b)[old_i][0]
                    old_i += 1
                if old_end == new_end - shift and new_end >= at + len(inserted):
                    break
            fresh.append((len(m[0]), self.counter[m[0]]))
            new_end = m.end()
        else:
            old_b = len(self.blocks) - 1
            old_i = len(self._block(old_b))
        self.encoded += len(fresh)
        rest = self._block(old_b)[old_i:]
        for i in range(b + 1, old_b + 1):
            self._set(i, [])
        joined = kept + fresh + rest
        if len(joined) > 16 * BLOCK:
            self.blocks[b] = joined
            self._build(self.leaves())
        else:
            self._set(b, joined)


def leaf_bytes(leaves: np.ndarray) -> bytes:
    """Two rows of leaves, compressed: a byte for each number, and four more for those of 255 and above."""
    x = leaves.ravel()
    return zlib.compress(np.uint32(leaves.shape[1]).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.uint32).tobytes(), 1)


def read_leaves(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    x = np.frombuffer(data[4 : 4 + 2 * n], np.uint8).astype(np.uint32)
    x[x == 255] = np.frombuffer(data[4 + 2 * n :], np.uint32)
    return x.reshape(2, n)


_EDITS = "array<struct<at:int,removed:int,inserted:string>>"


def kept(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """(doc_id, text, leaves, n_tokens, n_pretokens) of every row, and with edits_col its edits."""
    given = docs.sparkSession.sparkContext.broadcast(_file(vocabulary))  # a vocabulary's file, some MB
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(edits_col).alias("edits")] if edits_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(given.value)
        for batch in slices(batches):
            trees = [split_counts(t or "", counter) for t in batch.column(1).to_pylist()]
            new = [pa.array([leaf_bytes(x) for x in trees], pa.binary()), pa.array([int(x[1].sum()) for x in trees], pa.int64()), pa.array([x.shape[1] for x in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "leaves", "n_tokens", "n_pretokens"])

    return own.mapInArrow(run, f"doc_id long, text string, {f'edits {own.schema["edits"].dataType.simpleString()}, ' if edits_col else ''}leaves binary, n_tokens long, n_pretokens long")


def edited(trees: DataFrame, vocabulary: str = VOCABULARY, keep: bool = True) -> DataFrame:
    """(doc_id, text, leaves, n_tokens, n_pretokens, n_edits, n_tokens_before, n_pretokens_before, n_reencoded) of rows of kept() with a column edits of (at, removed, inserted); text, leaves and counts are those after the edits. Text and leaves are null unless they are to be kept."""
    given = trees.sparkSession.sparkContext.broadcast(_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(given.value)
        for batch in slices(batches):
            done, before = [], []
            for text, leaves, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                d = Document(text or "", counter, read_leaves(leaves))
                before.append((d.count, len(edits or ()), d.pre_tokens()))
                for e in edits or ():
                    e = e or {}
                    d.edit(e.get("at") or 0, e.get("removed") or 0, e.get("inserted") or "")
                done.append(d)
            ints = lambda x: pa.array(list(x), pa.int64())
            texts = pa.array([d.text if text is not None or d.text else None for d, text in zip(done, batch.column(1).to_pylist())] if keep else [None] * len(done), pa.string())
            cols = [batch.column(0), texts, pa.array([leaf_bytes(d.leaves()) if keep else None for d in done], pa.binary()), ints(d.count for d in done), ints(d.pre_tokens() for d in done), ints(b[1] for b in before), ints(b[0] for b in before), ints(b[2] for b in before), ints(d.encoded for d in done)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "leaves", "n_tokens", "n_pretokens", "n_edits", "n_tokens_before", "n_pretokens_before", "n_reencoded"])

    return trees.select("doc_id", "text", "leaves", "edits").mapInArrow(run, "doc_id long, text string, leaves binary, n_tokens long, n_pretokens long, n_edits long, n_tokens_before long, n_pretokens_before long, n_reencoded long")


@scoped
def counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_reencoded) of every row, with edits an array of (at, removed, inserted).

    The trees are written once and the edits applied to them.
    """
    own = docs if edits_col in docs.columns else docs.withColumn(edits_col, F.lit(None).cast(_EDITS))
    trees = written(kept(own, vocabulary, id_col, text_col, edits_col))
    after = edited(trees, vocabulary, keep=False)
    return after.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_pretokens_before").alias("n_pretokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), "n_reencoded")
