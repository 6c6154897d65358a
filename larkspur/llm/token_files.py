"""Operator 10: files of token ids behind an adaptive context-mixing range coder.

A file holds blocks of ids and a table of documents. Each block starts from a fresh model and carries checksums, so
blocks are read independently. The model mixes three predictions of the next id: the ids that
followed the last two ids and the last id before (orders 2 and 1, with adaptive weights by confidence), and the counts of
all ids of the block so far (order 0). The mixture drives a 64-bit range coder.

A block's ids are dealt to lanes, consecutive runs of equal length that are coded in step and share the model; each
numpy operation then serves thousands of ids.

Null and empty texts have no ids but the end id. Long texts go on over as many blocks as they need. Documents are ordered by id, null first, then by a hash of the text;
repeated rows are stored each. An empty table gives no files and no rows. Extra columns are not read.
Ids must be below 2^17. Tasks write files under names of their own; only files of attempts that succeeded are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import batches_of, new_file, open_folder, read_table, shared_files, tidy, utf8
from larkspur.session import materialise

END_ID = 2
BLOCK_IDS = 1 << 21
MAX_LANES = 4096
_LANE_IDS = 256
# Bytes of pieces of each kind and their ids kept by a task, some 35 a piece, bytes of the longest piece kept, and words
# given to the library in one string.
KEPT_BYTES = 48 << 20
KEPT_PIECE = 256
JOINED_WORDS = 1_000
# Bytes of texts encoded at a time; texts of more than the second, whose ids could outgrow an Arrow array, are given to the
# library as they are.
SLICE_BYTES = 12 << 20
WHOLE_BYTES = 500 << 20
# Signs that are letters, and signs that are none, in every version of Unicode that has them.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_OTHERS = "[\x00-@\\[-`{-\x7f\u2010-\u2027]"
_WORD = f"(?s)^(?P<stem>{_LETTERS}+)(?P<rest>{_OTHERS}.*)?$"
_LINE = re.compile(f"([!-&(-@]*\n)({_LETTERS}+)({_OTHERS}.*)?", re.DOTALL)
MAGIC = b"LKTOKEN1"
_BLOCK = struct.Struct("<IIIII")
_TAIL = struct.Struct("<QQQ8s")
# Bits of the mixture's total, of the total of order 0, and of the order-2 table.
_TOTAL, _ORDER0, _HASH = 26, 20, 18
# Confidence of a prediction, 1 to 8; level 0 is for no prediction yet. Entries of the tables are id * 16 + level.
_SURE, _BITS = 8, 4
# Changes of the confidence by level, after a miss and after a hit; after misses at levels below 2 the id met replaces it.
_STEPS = np.array([-(level + 1 >> 1) for level in range(16)] + [int(level < _SURE) for level in range(16)], dtype=np.int32)
# Weights are learnt from every step at first, then from one in so many.
_LEARN = 8


class Model:
    """Predictions of orders 0 to 2 and their weights; encoder and decoder keep it alike."""

    def __init__(self, symbols: int) -> None:
        self.symbols = symbols
        self.counts = np.zeros(symbols, dtype=np.int64)
        self.recent: list[np.ndarray] = []
        self.seen = self.counted = self.steps = 0
        self._count()
        # Index ``symbols`` stands for no id before, and as a prediction for none.
        self.next1 = np.full(symbols + 1, symbols << _BITS, dtype=np.int32)
        self.next2 = np.full(1 << _HASH, symbols << _BITS, dtype=np.int32)
        self.hits = np.ones((2, 1 << _BITS))
        self.tries = np.full((2, 1 << _BITS), 4.0)
        self._weigh()

    def _count(self) -> None:
        """Cumulated shares of order 0; every id keeps a share of one at least."""
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.symbols)
            self.recent = []
        # An equal count for all ids stands in before the first id.
        counts = self.counts if self.seen else np.ones(self.symbols, dtype=np.int64)
        summed = np.concatenate([[0], np.cumsum(counts)])
        shares = summed * ((1 << _ORDER0) - self.symbols) // summed[-1] + np.arange(self.symbols + 1)
        self.shares, self.shares_end = shares[:-1], shares[1:]
        self.by_share: np.ndarray | None = None
        self.counted = self.seen

    def _weigh(self) -> None:
        """Parts of the total for both levels, that of order 2 first, with equal guesses and with others."""
        weights = (np.clip(self.hits / self.tries, 2**-10, 0.75) * (1 << _TOTAL)).astype(np.int64)
        weights[:, 0] = 0
        part2 = weights[1][None, :, None]
        rest = (1 << _TOTAL) - part2
        part1 = (weights[0][None, None, :] * rest >> _TOTAL) * np.array([0, 1])[:, None, None]
        self.parts2 = np.broadcast_to(part2, part1.shape).ravel()
        self.parts1, self.parts0, self.parts12 = part1.ravel(), (rest - part1).ravel(), (part1 + part2).ravel()

    def predict(self, last1: np.ndarray, last2: np.ndarray) -> None:
        """Predicted ids and their parts of the total, for each lane."""
        self.slot1 = last1
        hashed = last1.astype(np.uint32) * np.uint32(0x9E3779B1)
        hashed += last2.astype(np.uint32) * np.uint32(0x2545F491)
        hashed >>= np.uint32(32 - _HASH)
        self.slot2 = hashed.astype(np.int64)
        self.entry1, self.entry2 = self.next1.take(self.slot1), self.next2.take(self.slot2)
        self.guess1, self.guess2 = self.entry1 >> _BITS, self.entry2 >> _BITS
        self.level1, self.level2 = self.entry1 & 15, self.entry2 & 15
        self.levels = (self.guess1 != self.guess2).astype(np.int64)
        self.levels <<= _BITS
        self.levels += self.level2
        self.levels <<= _BITS
        self.levels += self.level1
        self.part0, self.both = self.parts0.take(self.levels), self.parts12.take(self.levels)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids' parts of the total."""
        short = ids.astype(np.int32)
        self.hit1, self.hit2 = short == self.guess1, short == self.guess2
        start, width = self.shares.take(ids), self.shares_end.take(ids)
        for share in (start, width):
            share *= self.part0
            share >>= _ORDER0
        width -= start
        start += self.both
        hit = np.flatnonzero(self.hit1)
        levels = self.levels.take(hit)
        start[hit], width[hit] = self.parts2.take(levels), self.parts1.take(levels)
        hit = np.flatnonzero(self.hit2)
        start[hit], width[hit] = 0, self.parts2.take(self.levels.take(hit))
        return start, width

    def id_at(self, value: np.ndarray) -> np.ndarray:
        """The ids whose parts hold the values."""
        ids = np.where(value < self.parts2.take(self.levels), self.guess2, self.guess1).astype(np.int64)
        plain = np.flatnonzero(value >= self.both)
        # Below 2^46 over below 2^26: the quotient of doubles is never rounded up to a whole number.
        share = value.take(plain)
        share -= self.both.take(plain)
        share += 1
        share <<= _ORDER0
        share -= 1
        if self.by_share is None:
            small = np.uint16 if self.symbols <= 1 << 16 else np.int32
            self.by_share = np.repeat(np.arange(self.symbols, dtype=small), self.shares_end - self.shares)
        ids[plain] = self.by_share.take((share / self.part0.take(plain)).astype(np.int64))
        return ids

    def update(self, ids: np.ndarray) -> None:
        """Learn the ids for which ``interval`` was asked last."""
        self.recent.append(ids)
        self.seen += len(ids)
        if self.seen >= 1.5 * self.counted:
            self._count()
        fresh = (ids.astype(np.int32) << _BITS) + 1
        learn = self.steps < 2 * _LEARN or self.steps % _LEARN == 0
        for order, (table, slot, entry, level, hit) in enumerate((
            (self.next1, self.slot1, self.entry1, self.level1, self.hit1),
            (self.next2, self.slot2, self.entry2, self.level2, self.hit2),
        )):
            level += hit.view(np.int8) * np.int8(16)
            entry += _STEPS.take(level)
            table[slot] = np.where(level < 2, fresh, entry)
            if learn:
                met = np.bincount(level, minlength=32).reshape(2, 16)
                self.tries[order] += met.sum(axis=0)
                self.hits[order] += met[1]
        if learn:
            self._weigh()
        self.steps += 1


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block and ids in each but the last."""
    steps = -(-n // min(MAX_LANES, max(1, n // _LANE_IDS)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, symbols: int) -> bytes:
    """A block: header with checksums, the number of words of each lane, the lanes' words."""
    n = len(ids)
    lanes, steps = _lanes(n)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(symbols)
    low = np.zeros(lanes, dtype=np.uint64)
    width = np.full(lanes, 2**64 - 1, dtype=np.uint64)
    # Words as they come, the lanes that they are of, and the place of each lane's last word, to which a carry goes.
    words = np.empty(lanes * (steps + 2), dtype=np.int64)
    owners = np.empty(lanes * (steps + 2), dtype=np.uint16)
    place = np.zeros(lanes, dtype=np.int64)
    end = 0
    last1 = np.full(lanes, symbols)
    last2 = np.full(lanes, symbols)
    tail = n - (lanes - 1) * steps

    def put(owner: np.ndarray, word: np.ndarray) -> None:
        nonlocal end
        place[owner] = np.arange(end, end + len(owner))
        words[end : end + len(owner)], owners[end : end + len(owner)] = word, owner
        end += len(owner)

    for step in range(steps):
        used = lanes if step < tail else lanes - 1
        now = grid[step, :used].astype(np.int64)
        model.predict(last1[:used], last2[:used])
        start, part = model.interval(now)
        unit = width[:used] >> np.uint64(_TOTAL)
        before = low[:used]
        after = unit * start.view(np.uint64)
        after += before
        carried = np.flatnonzero(after < before)
        words[place.take(carried)] += 1
        unit *= part.view(np.uint64)
        full = np.flatnonzero(unit < np.uint64(1 << 32))
        moved = after.take(full)
        put(full, moved >> np.uint64(32))
        after[full] = moved << np.uint64(32)
        unit[full] = unit.take(full) << np.uint64(32)
        low[:used], width[:used] = after, unit
        last2, last1 = last1, now
        model.update(now)
    line = np.arange(lanes)
    put(line, low >> np.uint64(32))
    put(line, low & np.uint64(0xFFFFFFFF))
    words = words[:end][np.argsort(owners[:end], kind="stable")]
    while len(over := np.flatnonzero(words >> 32)):
        words[over - 1] += words[over] >> 32
        words[over] &= 0xFFFFFFFF
    body = np.bincount(owners[:end], minlength=lanes).astype("<u4").tobytes() + words.astype("<u4").tobytes()
    return _BLOCK.pack(n, symbols, len(body), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(block: bytes) -> np.ndarray:
    n, symbols, size, body_sum, ids_sum = _BLOCK.unpack_from(block)
    body = block[_BLOCK.size : _BLOCK.size + size]
    if len(body) != size or zlib.crc32(body) != body_sum:
        raise ValueError("a block of token ids is damaged")
    lanes, steps = _lanes(n)
    counts = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.frombuffer(body + bytes(8), "<u4", offset=4 * lanes)
    at = np.cumsum(counts) - counts
    code = words[at].astype(np.uint64) << np.uint64(32) | words[at + 1]
    at += 2
    width = np.full(lanes, 2**64 - 1, dtype=np.uint64)
    grid = np.zeros((steps, lanes), dtype="<u4")
    model = Model(symbols)
    last1 = np.full(lanes, symbols)
    last2 = np.full(lanes, symbols)
    tail = n - (lanes - 1) * steps
    for step in range(steps):
        used = lanes if step < tail else lanes - 1
        model.predict(last1[:used], last2[:used])
        unit = width[:used] >> np.uint64(_TOTAL)
        rest = code[:used]
        now = model.id_at((rest // unit).view(np.int64))
        start, part = model.interval(now)
        rest -= unit * start.view(np.uint64)
        unit *= part.view(np.uint64)
        full = np.flatnonzero(unit < np.uint64(1 << 32))
        read = at.take(full)
        rest[full] = rest.take(full) << np.uint64(32) | words.take(read)
        at[full] = read + 1
        unit[full] = unit.take(full) << np.uint64(32)
        width[:used] = unit
        grid[step, :used] = now
        last2, last1 = last1, now
        model.update(now)
    ids = grid.T.ravel()[:n]
    if zlib.crc32(ids.tobytes()) != ids_sum:
        raise ValueError("a block of token ids decodes to other ids")
    return ids


class TokenFileWriter:
    """Blocks, then per document its id and number of ids, then a tail that tells where those begin."""

    def __init__(self, uri: str, symbols: int, block_ids: int) -> None:
        system, self.name = new_file(uri, ".tok")
        self.stream = system.open_output_stream(self.name, compression=None)
        self.symbols, self.block_ids = symbols, block_ids
        self.size = self.stream.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.held_ids = self.total = 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.total += len(ids)
        while self.held_ids + len(ids) >= self.block_ids:
            cut = self.block_ids - self.held_ids
            self.held.append(ids[:cut])
            ids = ids[cut:]
            self._end_block()
        self.held.append(ids)
        self.held_ids += len(ids)

    def _end_block(self) -> None:
        ids = np.concatenate(self.held)
        if len(ids):
            self.size += self.stream.write(encode_block(ids, self.symbols))
        self.held, self.held_ids = [], 0

    def close(self) -> None:
        if self.held:
            self._end_block()
        known = np.array([d is not None for d, _ in self.docs], dtype=np.uint8)
        names = np.array([d or 0 for d, _ in self.docs], dtype="<i8")
        sizes = np.array([n for _, n in self.docs], dtype="<u8")
        body = known.tobytes() + names.tobytes() + sizes.tobytes()
        self.stream.write(body + _TAIL.pack(self.size, len(self.docs), zlib.crc32(body), MAGIC))
        self.stream.close()


def read_token_file(uri: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in order, a block in memory at a time."""
    system, _ = open_folder(uri)
    file = system.open_input_file(name)
    end = file.size() - _TAIL.size
    blocks_end, n, checksum, magic = _TAIL.unpack(file.read_at(_TAIL.size, end))
    body = file.read_at(end - blocks_end, blocks_end)
    if magic != MAGIC or zlib.crc32(body) != checksum:
        raise ValueError(f"{name} is damaged")
    known, names = np.frombuffer(body, np.uint8, n), np.frombuffer(body, "<i8", n, n)
    sizes = np.frombuffer(body, "<u8", n, 9 * n)
    at, held = len(MAGIC), np.empty(0, dtype="<u4")
    for i in range(n):
        need, parts = int(sizes[i]), []
        while need > len(held):
            parts.append(held)
            need -= len(held)
            size = _BLOCK.size + _BLOCK.unpack(file.read_at(_BLOCK.size, at))[2]
            held = decode_block(file.read_at(size, at))
            at += size
        parts.append(held[:need])
        held = held[need:]
        yield int(names[i]) if known[i] else None, np.concatenate(parts)


class PieceIds:
    """Ids of the pieces met so far, by their text; only those that a call asks for stay when they are too many."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = KEPT_BYTES) -> None:
        self.encode, self.limit = encode, limit
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def of(self, wanted: pa.StringArray) -> pa.BinaryArray:
        at = pc.index_in(wanted, value_set=self.pieces)
        if not at.null_count:
            return self.ids.take(at)
        new = wanted.filter(at.is_null()).unique()
        coded = pa.array(self.encode(new.to_pylist()), pa.binary())
        if sum(a.nbytes for a in (self.pieces, self.ids, new, coded)) > self.limit:
            used = at.drop_null().unique()
            self.pieces, self.ids = self.pieces.take(used), self.ids.take(used)
            at = pc.index_in(wanted, value_set=self.pieces)
        missing = at.is_null()
        added = pc.add(pc.index_in(wanted.filter(missing), value_set=new), pa.scalar(len(self.pieces), pa.int32()))
        found = pa.concat_arrays([self.ids, coded]).take(pc.replace_with_mask(at, missing, added))
        # Long pieces, which hardly come again, are not kept.
        short = pc.less_equal(pc.binary_length(new), KEPT_PIECE)
        self.pieces = pa.concat_arrays([self.pieces, new.filter(short)])
        self.ids = pa.concat_arrays([self.ids, coded.filter(short)])
        return found


class LibraryEncoder:
    """Ids by the tokenizers library, each distinct piece once.

    Texts are cut into words at single blanks, see ``larkspur.llm.words``, and words after their leading letters and
    after a line's end: no match of the byte-level pattern goes on from a letter to another sign, nor from one white
    space sign to a letter.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.symbols = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Bytes that an id stands for: a character each in the vocabulary, but for added tokens.
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.symbols)]
        self.lengths = np.array([len(name) for name in names], dtype=np.int64)
        # Words with an added token are not cut.
        self.added: list[str] = []
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.lengths[i] = len(token.content.encode())
            self.added.append(token.content)
        self.stems = PieceIds(self._encode_words)
        self.rests = PieceIds(self._encode_rests)
        self.lines = PieceIds(self._encode_lines)

    def _encode(self, strings: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [np.array(c.ids, dtype="<u4").tobytes() for c in coded]

    def _encode_words(self, words: list[str], before: str = " ") -> list[bytes]:
        """Words after a blank, ``JOINED_WORDS`` in a string, cut where the ids' bytes reach a word's end."""
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        coded = self.tokenizer.encode_batch_fast([before + before.join(g) for g in groups], add_special_tokens=False)
        out: list[bytes] = []
        for group, found in zip(groups, coded, strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in group])
            reached = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if cuts[-1] != len(ids) or (reached[cuts - 1] != ends).any():
                # Ids that do not end with the words.
                out += self._encode([before + w for w in group])
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in pairwise([0, *(4 * cuts).tolist()])]
        return out

    def _encode_lines(self, words: list[str]) -> list[bytes]:
        """Words of letters with nothing before them: as after a line's end, which is an id of its own."""
        return [ids[4:] for ids in self._encode_words(words, "\n")]

    def _encode_rests(self, rests: list[str]) -> list[bytes]:
        """What follows the letters of a word; letters that begin a line in it are looked up apart."""
        parts = [m.groups() if (m := _LINE.fullmatch(r)) else (r, None, None) for r in rests]
        signs = list({sign for before, _, after in parts for sign in (before, after) if sign})
        known = dict(zip(signs, self._encode(signs), strict=True)) | {"": b"", None: b""}
        letters = pa.array([word for _, word, _ in parts], pa.string())
        coded = self.lines.of(letters.drop_null())
        words = iter(coded.to_pylist())
        return [known[before] + (next(words) if word else b"") + known[after] for before, word, after in parts]

    def _word_ids(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of distinct words after a blank, without white space at their ends."""
        parts = pc.extract_regex(words, _WORD)
        whole = parts.is_null()
        for content in self.added:
            whole = pc.or_(whole, pc.match_substring(words, content))
        stems = pc.if_else(whole, words, parts.field("stem"))
        rests = pc.if_else(whole, "", parts.field("rest"))
        return pc.binary_join_element_wise(self.stems.of(stems), self.rests.of(rests), b"")

    def encode(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.split_pattern(texts, " ")
        # Where each text's words begin; the words that differ, and which of them stands at each place.
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        flat = split.flatten().dictionary_encode()
        words, index = flat.dictionary, flat.indices.to_numpy().copy()

        def differs(other: pa.StringArray) -> np.ndarray:
            return pc.not_equal(pc.binary_length(other), pc.binary_length(words)).to_numpy(zero_copy_only=False)

        # A trailing blank leaves an empty word, a blank alone; others lie beside another blank.
        empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        left, right = differs(pc.utf8_ltrim_whitespace(words)), differs(pc.utf8_rtrim_whitespace(words))
        spaced = left | right | empty
        at = np.flatnonzero(spaced[index])
        owner = np.searchsorted(bounds, at, side="right") - 1
        inner_left, inner_right = at > bounds[owner], at < bounds[owner + 1] - 1
        word = index[at]
        odd = left[word] & inner_left | right[word] & inner_right | empty[word] & inner_left & inner_right
        whole = np.zeros(len(texts), dtype=bool)
        whole[owner[odd]] = True
        whole |= pc.binary_length(texts).to_numpy() > WHOLE_BYTES
        if whole.any():
            coded = iter(self._encode(texts.filter(pa.array(whole)).to_pylist()))
            others = iter(self.encode(texts.filter(pa.array(~whole))) if not whole.all() else [])
            return [np.frombuffer(next(coded), "<u4") if w else next(others) for w in whole.tolist()]
        # The first part of each text has no blank before it.
        first = bounds[:-1]
        firsts = self._encode(words.take(pa.array(index[first])).to_pylist())
        ends = self._encode([" " + w for w in words.filter(pa.array(spaced)).to_pylist()])
        ids = pa.concat_arrays([
            self._word_ids(words.filter(pa.array(~spaced))), pa.array(ends, pa.binary()), pa.array(firsts, pa.binary())
        ])
        place = np.empty(len(words) + len(texts), dtype=np.int32)
        place[np.flatnonzero(~spaced)] = np.arange(len(words) - len(ends))
        place[np.flatnonzero(spaced)] = np.arange(len(words) - len(ends), len(words))
        place[len(words) :] = np.arange(len(words), len(place))
        index[first] = np.arange(len(words), len(place))
        taken = ids.take(pa.array(place[index]))
        _, offsets, data = taken.buffers()
        cuts = np.frombuffer(offsets, np.int32, len(taken) + 1)[bounds] // 4
        coded = np.frombuffer(data, "<u4") if data else np.empty(0, "<u4")
        return [coded[a:b] for a, b in pairwise(cuts.tolist())]


def _slices(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Parts of at most ``SLICE_BYTES``, or one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield texts.slice(start, end - start)
        start = end


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(
    df: DataFrame, path: str, uri: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Encode and write all texts in ascending order of ``doc_id``; returns the written list of files."""

    @tidy
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        end = np.array([end_id], dtype="<u4")
        writer: TokenFileWriter | None = None
        for batch in batches:
            names = iter(batch["doc_id"].to_pylist())
            for part in _slices(batch["utf8"].cast(pa.string())):
                for ids in coder.encode(part):
                    writer = writer or TokenFileWriter(uri, coder.symbols, block_ids)
                    writer.add(next(names), np.append(ids, end))
        if writer:
            writer.close()
            row = {"part": TaskContext.get().partitionId(), "file": writer.name, "n_ids": writer.total}
            schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64())])
            yield from batches_of([row], schema)

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("utf8"))
    order = [F.col("doc_id"), F.xxhash64("utf8")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.mapInArrow(written, "part int, file string, n_ids bigint"), "token_files")


def read_token_files(files: DataFrame, uri: str) -> DataFrame:
    """One row per document: its id, the ids of all documents before it, its number of ids and their checksum."""
    # One row per file of many megabytes; the window over them is small whatever the input.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())
        ])

        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    start = row["first"]
                    for name, ids in read_token_file(uri, row["file"]):
                        checksum = zlib.crc32(ids.tobytes())
                        yield {"doc_id": name, "start": start, "n_tokens": len(ids), "ids_crc32": checksum}
                        start += len(ids)

        yield from batches_of(rows(), schema)

    # The rows are few and small, but each stands for a file: one task for each.
    dealt = placed.repartition(max(1, files.count()), "part")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = shared_files(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents")
    files = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), uri)
    return read_token_files(files, uri)
