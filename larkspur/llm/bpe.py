"""Operator 8: byte-level BPE encoding and decoding on padded matrices.

A batch's distinct pieces (matches of the pattern) are sorted into matrices by length. In each round every row merges its
leftmost pair of least rank; ranks come from an open-addressing hash table of token pairs, and finished
rows leave the matrix. Pieces that are tokens themselves are one id. Long pieces, whose matrix
would be shuffled once for each of thousands of merges, keep their ranks in blocks with a least rank each, so a
round touches two blocks; the merges are the same.

Null counts as empty and has no tokens. Texts of any length are encoded whole; repeated rows are encoded like any
other. An empty table gives no rows. Extra columns are not read, or travel inside a struct. The ranks must hold all 256 bytes;
ids are ranks. The piece cache of a worker is emptied when full, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import ROW, read_table, small_batches, tidy, utf8, whole_row
from larkspur.llm.words import WordCache

NONE = np.int32(2**31 - 1)
# Pieces up to this many bytes go into matrices.
MATRIX_BYTES = 128
_MATRIX_CELLS = 1 << 20
_RESULT = "n_tokens bigint, ids binary, decoded_sha256 string"


class PairTable:
    """Rank of the token that two tokens make, by open addressing with linear probing."""

    def __init__(self, tokens: dict[bytes, int]) -> None:
        found = [
            (left, right, rank)
            for token, rank in tokens.items()
            for cut in range(1, len(token))
            if (left := tokens.get(token[:cut])) is not None and (right := tokens.get(token[cut:])) is not None
        ]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 3)
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys, ranks = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2].astype(np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            mine = self.keys[slots] == keys
            self.ranks[slots[mine]] = ranks[mine]
            keys, ranks, slots = keys[~mine], ranks[~mine], (slots[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a negative id makes none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        flat = keys.ravel()
        out = np.full(flat.size, NONE, dtype=np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(flat[open_])
        while open_.size:
            held = self.keys[slots]
            hit = held == flat[open_]
            out[open_[hit]] = self.ranks[slots[hit]]
            on = ~hit & (held != -1)
            open_, slots = open_[on], (slots[on] + 1) & self.mask
        return out.reshape(keys.shape)


class Encoder:
    """Ids of pieces and bytes of ids for one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.words = WordCache(self.encode_strings)

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of up to ``width`` bytes."""
        out = [b""] * len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), np.uint8).reshape(-1, width + 1)
        sizes = np.array([len(p) for p in pieces])
        columns = np.arange(width + 1)
        ids = np.where(columns < sizes[:, None], self.byte_ids[raw], np.int32(-1))
        rows = np.arange(len(pieces))
        ranks = self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            line = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            least = ranks[line, at]
            done = least == NONE
            if done.any():
                ended = ids[done].astype("<u4").tobytes()
                step = 4 * ids.shape[1]
                for i, (row, size) in enumerate(zip(rows[done].tolist(), sizes[done].tolist(), strict=True)):
                    out[row] = ended[i * step : i * step + 4 * size]
                rows, ids, ranks, at, least, sizes = (x[~done] for x in (rows, ids, ranks, at, least, sizes))
                if not len(rows):
                    break
                line = line[: len(rows)]
                # The longest row left decides the width from here on.
                width = min(width, int(sizes.max()))
                ids, ranks, columns = ids[:, : width + 1], ranks[:, :width], columns[: width + 1]
            # All ids after the merged pair move one place to the left.
            moved = np.minimum(columns + (columns > at[:, None]), width)
            ids = ids[line[:, None], moved]
            ids[:, -1] = -1
            ids[line, at] = least
            ranks = ranks[line[:, None], np.minimum(moved[:, :-1], width - 1)]
            ranks[:, -1] = NONE
            ranks[line, at] = self.pairs.look_up(least, ids[line, at + 1])
            before = at > 0
            ranks[line[before], at[before] - 1] = self.pairs.look_up(ids[line[before], at[before] - 1], least[before])
            sizes -= 1
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece, by the same merges."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].copy()
        n = len(ids)
        side = max(16, int(n**0.5))
        blocks = -(-n // side)
        ranks = np.full(blocks * side, NONE, dtype=np.int32)
        ranks[: n - 1] = self.pairs.look_up(ids[:-1], ids[1:])
        grid = ranks.reshape(blocks, side)
        least = grid.min(axis=1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        known: dict[tuple[int, int], int] = {}

        def rank(left: int, right: int) -> int:
            if (left, right) not in known:
                known[left, right] = int(self.pairs.look_up(np.array([left]), np.array([right]))[0])
            return known[left, right]

        while True:
            block = int(least.argmin())
            if least[block] == NONE:
                break
            i = block * side + int(grid[block].argmin())
            gone = int(after[i])
            ids[i] = ranks[i]
            end = int(after[gone]) if gone < n else n
            after[i] = end
            ids[gone] = -1
            ranks[gone] = NONE
            if end < n:
                before[end] = i
                ranks[i] = rank(int(ids[i]), int(ids[end]))
            else:
                ranks[i] = NONE
            touched = {block, gone // side}
            last = int(before[i])
            if last >= 0:
                ranks[last] = rank(int(ids[last]), int(ids[i]))
                touched.add(last // side)
            for b in touched:
                least[b] = grid[b].min()
        return ids[ids >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > MATRIX_BYTES:
                out[i] = self._long(piece).astype("<u4").tobytes()
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, members in by_width.items():
            step = max(1, _MATRIX_CELLS // width)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        """Ids of strings, split into pieces by the pattern."""
        split = [self.pattern.findall(s) for s in strings]
        pieces = list(set().union(*split))
        ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]), strict=True))
        return [b"".join([ids[p] for p in found]) for found in split]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.words.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_and_decode(
    df: DataFrame, path: str, pattern: str, text_column: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """Each row of ``df``, or some ``columns`` of it, as struct ``row`` with its ids and the hash of the bytes they decode to."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = encoder(path, pattern)
        for batch in batches:
            ids: list[bytes] = []
            # Some texts at a time, so that the pieces of a batch are never all in memory.
            texts = batch["utf8"]
            for start in range(0, len(texts), 500):
                ids += used.encode_batch([t.decode() for t in texts.slice(start, 500).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch[ROW],
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([hashlib.sha256(used.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                [ROW, "n_tokens", "ids", "decoded_sha256"],
            )

    kept = df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])
    rows = small_batches(df).select(whole_row(kept), utf8(F.col(f"`{text_column}`")).alias("utf8"))
    return rows.mapInArrow(tidy(encoded), T.StructType([rows.schema[ROW], *T.StructType.fromDDL(_RESULT)]))


def token_report(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, number of tokens and the hashes of the ids and of the decoded bytes."""
    coded = encode_and_decode(df.select("doc_id", "text"), path, pattern, columns=["doc_id"])
    return coded.select(f"{ROW}.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_report(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
