"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

Leaves are runs of pieces cut where no pre-token crosses (see ``encode``);
inner nodes hold sums of characters and tokens. An edit descends by characters
to the leaves it touches, takes one untouched leaf on either side as context,
encodes that region again and updates the sums above it. The edges of the
region keep their neighbours, so they stay cuts and all other leaves keep
their counts. A text in which the string of a special token stands or comes up
is counted whole from then on.

Nulls: a null text is an empty one with 0 tokens; a null list of edits is an
empty one. Edits beyond the end are clamped to it. Edits are applied in order,
each to the text the one before left. Repeated rows are counted each; other
columns are ignored; empty tables give empty results; very long texts are
whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .encode import Encoder, cuts, encoded, tokenizer_path

#: Pieces of a leaf; a tree whose leaf outgrows this many times that is built anew.
LEAF, GROWTH = 8, 16


class TokenTree:
    """Token count of one text under edits."""

    def __init__(self, enc: Encoder, text: str | bytes = b"", built: tuple | None = None):
        self.enc, self.encoded, self.whole = enc, 0, False
        if built:
            self._place(*built)
        else:
            self._build(text.encode() if isinstance(text, str) else text)

    @staticmethod
    def of(enc: Encoder, column: pa.Array) -> list[TokenTree]:
        """Trees of all rows of a column, their pieces found and counted together."""
        data, offsets = X.raw(X.strings(column))
        whole = enc._whole(data, offsets)
        at = cuts(data, offsets)
        piece = enc.pieces(data, at)
        counts = np.concatenate([[0], np.cumsum(enc.length[piece])])
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first, out, own = np.searchsorted(at, offsets).tolist(), [], data.tobytes()
        ends = np.append(at, len(data))
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if i in whole or a == b:
                out.append(TokenTree(enc, own[offsets[i] : offsets[i + 1]]))
                continue
            leaf = np.append(np.arange(a, b, LEAF), b)
            edge = ends[leaf]
            places = edge.tolist()
            out.append(TokenTree(enc, built=([own[x:y] for x, y in zip(places[:-1], places[1:], strict=True)], np.diff(counts[leaf]), np.diff(chars[edge]))))
        return out

    def _build(self, data: bytes) -> None:
        self.whole = self._special(data)
        plain = data and not self.whole
        leaves = self._leaves(data, LEAF) if plain else [data]
        self._place(leaves, self._counts(data, LEAF) if plain else [self._count(data)], [_chars(x) for x in leaves])

    def _place(self, leaves: list[bytes], tokens, chars) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.tokens_, self.chars_ = self._sums(tokens), self._sums(chars)

    def _sums(self, values) -> list[int]:
        level = np.zeros(self.size, np.int64)
        level[: len(values)] = values
        rows = [level.tolist()]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            rows.append(level.tolist())
        return [0, *(x for row in reversed(rows) for x in row)]

    @property
    def tokens(self) -> int:
        return int(self.tokens_[1])

    @property
    def chars(self) -> int:
        return int(self.chars_[1])

    def text(self) -> str:
        return b"".join(self.leaves).decode()

    def _special(self, data: bytes) -> bool:
        low = data.lower()
        return any(s in low for s in self.enc.special)

    def _count(self, data: bytes) -> int:
        return len(self.enc.tokenizer.encode(data.decode(), add_special_tokens=False).ids)

    def _cut(self, data: bytes, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.frombuffer(data, np.uint8)
        at = cuts(own, np.array([0, len(own)]))
        return own, at, np.arange(0, len(at), step)

    def _leaves(self, data: bytes, step: int) -> list[bytes]:
        _, at, first = self._cut(data, step)
        ends = np.append(at[first][1:], len(data))
        return [data[a:b] for a, b in zip(at[first], ends, strict=True)]

    def _counts(self, data: bytes, step: int) -> np.ndarray:
        own, at, first = self._cut(data, step)
        self.encoded += len(data)
        edge = [*at.tolist(), len(data)]
        names = [data[a:b].decode() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return np.add.reduceat(self.enc.length[self.enc.places(names)], first)

    def _leaf(self, char: int) -> tuple[int, int]:
        """Leaf that holds the character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char - before >= self.chars_[node] and self.chars_[node + 1]:
                before += int(self.chars_[node])
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, data: bytes, tokens: int) -> None:
        self.leaves[leaf] = data
        node = leaf + self.size
        more, chars = tokens - self.tokens_[node], _chars(data) - self.chars_[node]
        while node:
            self.tokens_[node] += more
            self.chars_[node] += chars
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters start to end."""
        start = min(max(0, start), self.chars)
        end = min(max(start, end), self.chars)
        first, before = self._leaf(start)
        last, _ = self._leaf(max(start, end - 1))
        first, last = min(first, len(self.leaves) - 1), min(last, len(self.leaves) - 1)
        own = b"".join(self.leaves[first : last + 1]).decode()
        data = (own[: start - before] + new + own[end - before :]).encode()
        low, high = self._context(first, -1), self._context(last, 1)
        region = b"".join(self.leaves[low:first]) + data + b"".join(self.leaves[last + 1 : high + 1])
        reach = max(map(len, self.enc.special), default=0)
        left, i = b"", low
        while i > 0 and len(left) < reach:
            i -= 1
            left = self.leaves[i] + left
        right, j = b"", high
        while j + 1 < len(self.leaves) and len(right) < reach:
            j += 1
            right += self.leaves[j]
        if self.whole or self._special(left[-reach:] + region + right[:reach] if reach else region):
            self._build(b"".join(self.leaves[:low]) + region + b"".join(self.leaves[high + 1 :]))
            return
        n = high - low + 1
        pieces = len(self._cut(region, 1)[1]) if region else 0
        if pieces > GROWTH * LEAF * n:
            self._build(b"".join(self.leaves[:low]) + region + b"".join(self.leaves[high + 1 :]))
            return
        step = max(1, -(-pieces // n))
        parts = self._leaves(region, step) if region else []
        counts = self._counts(region, step) if region else []
        for k in range(n):
            self._set(low + k, parts[k] if k < len(parts) else b"", int(counts[k]) if k < len(parts) else 0)

    def _context(self, leaf: int, step: int) -> int:
        """The next leaf with two characters or more, or the end."""
        at = leaf
        while 0 <= at + step < len(self.leaves):
            at += step
            if self.chars_[self.size + at] >= 2:
                break
        return at


def _chars(data: bytes) -> int:
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum()) if data else 0


def count_edited(docs: DataFrame, path: str, edits: str = "edits", *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Token counts before and after the edits of each row.

    The column ``edits`` is array<struct<start:int,stop:int,new:string>>, in
    characters. Returns the id, n_tokens, n_edits, n_tokens_edited,
    n_chars_edited, n_bytes_encoded (by the edits alone) and, where asked
    for, the edited text.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(edits).alias("edits"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for enc, block in encoded(path, batches):
            yield counted(enc, block)

    def counted(enc: Encoder, block: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for tree, changes in zip(TokenTree.of(enc, block.column("text")), block.column("edits").to_pylist(), strict=True):
            out[0].append(tree.tokens)
            tree.encoded = 0
            changes = changes or []
            for c in changes:
                if c is not None:
                    tree.edit(c["start"] or 0, c["stop"] or 0, c["new"] or "")
            for x, v in zip(out[1:], (len(changes), tree.tokens, tree.chars, tree.encoded, tree.text() if keep_text else ""), strict=True):
                x.append(v)
        cols = [block.column("id"), *(pa.array(x, pa.int64()) for x in out[:5])] + [pa.array(out[5], pa.string())] * keep_text
        return pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_bytes_encoded"] + ["edited"] * keep_text)

    return docs.mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_bytes_encoded long" + ", edited string" * keep_text)


def sample_edits(id_col: str = "doc_id", text_col: str = "text"):
    """Three edits that follow from a row's id and length: a word put in, a few characters taken out, some replaced."""
    n = F.coalesce(F.char_length(text_col), F.lit(0))
    at = lambda seed: F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), n + 1).cast("int")
    edit = lambda seed, size, new: F.struct(at(seed).alias("start"), (at(seed) + size).alias("stop"), F.lit(new).alias("new"))
    return F.array(edit(1, 0, " revised"), edit(2, 7, ""), edit(3, 3, " in 2024, "))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents`` before and after three edits of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("edits", sample_edits())
    return count_edited(docs, tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
