"""Operator 4: benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (ten consecutive normalised words; a shorter item is one window) are a stored table. Tasks
read it from the shared folder and build one automaton of it, once; the driver never sees a window. A document is normalised and scanned once; word
numbers of the hits lead back to offsets in the original text.

Null and empty texts have no words and hit nothing. Items without words have no window. Items
with the same id count once; a null id counts as ``null``. Repeated documents give repeated rows, an empty
table no rows, an empty benchmark no hits. Extra columns are not read, or travel inside a struct.

A benchmark whose windows exceed ``WINDOW_BYTES`` is cut into blocks by the windows' hash. A task then scans its texts in portions
of ``TEXT_BYTES`` with one automaton after the other, so it holds one at a time, some forty times as large as its
windows, and no window is left out.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import (
    ROW, open_folder, read_table, sha256_hex, shared_files, small_batches, stored, texts_of, tidy, utf8, whole_row,
)

WINDOW_WORDS = 10
WINDOW_BYTES = 6 << 20
TEXT_BYTES = 64 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# ASCII letters in lower case; every other ASCII character that is no digit separates words.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256)
)
_RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(words: list[bytes], size: int = WINDOW_WORDS) -> Iterator[bytes]:
    """Windows with a blank on either side, so that they match whole words only."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield b" " + b" ".join(words[i : i + size]) + b" "


def _item_windows(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [
                (item, window)
                for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for window in dict.fromkeys(windows_of(words_of(text), size))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())],
                ["item", "window"],
            )

    return found


def _store_windows(windows: DataFrame, limit: int) -> tuple[str, int]:
    """Write all windows with their items, in blocks of about ``limit`` bytes; returns the folder and the number of blocks."""
    grouped = stored(windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    size = F.octet_length("window") + F.octet_length(F.array_join("items", ""))
    total = grouped.agg(F.sum(size.cast("bigint"))).first()[0]
    blocks = 0 if total is None else total // limit + 1
    folder = shared_files(windows.sparkSession, "blocks")
    if blocks:
        dealt = grouped.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
        dealt.repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks


def _automaton(folder: str, block: int) -> ahocorasick.Automaton | None:
    system, path = open_folder(f"{folder}/block={block}")
    automaton = ahocorasick.Automaton()
    if system.get_file_info(path).type != pafs.FileType.NotFound:
        for batch in pq.read_table(path, filesystem=system, columns=["window", "items"], partitioning=None).to_batches():
            for window, items in zip(batch["window"].to_pylist(), batch["items"].to_pylist(), strict=True):
                automaton.add_word(window.decode("latin-1"), (len(window), items))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _portions(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that have about ``limit`` bytes together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _code_points(text: bytes, offsets: list[int]) -> list[int]:
    """Code points before each of the ascending byte offsets."""
    out, done, count = [], 0, 0
    for offset in offsets:
        count += len(text[done:offset].decode("utf-8"))
        done = offset
        out.append(count)
    return out


def scan(text: bytes, automaton: ahocorasick.Automaton | None) -> tuple[int, set[int], set[str]]:
    """Number of words, numbers of the words hit, items found."""
    words = words_of(text)
    hit: set[int] = set()
    items: set[str] = set()
    if words and automaton is not None:
        line = " " + b" ".join(words).decode("latin-1") + " "
        blanks: list[int] | None = None
        for end, (length, found) in automaton.iter(line):
            if blanks is None:
                blanks = [i for i, c in enumerate(line) if c == " "]
            first = bisect.bisect_left(blanks, end - length + 1)
            hit.update(range(first, bisect.bisect_left(blanks, end)))
            items.update(found)
    return len(words), hit, items


def hit_spans(text: bytes, hit: set[int]) -> list[dict[str, int]]:
    """Runs of hit words as code point offsets in the original text, end exclusive."""
    places = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    offsets = _code_points(text, [o for a, b in runs for o in (places[a][0], places[b][1])])
    return [{"start": a, "end": b} for a, b in zip(offsets[::2], offsets[1::2], strict=True)]


def mark_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window_words: int = WINDOW_WORDS,
    window_bytes: int = WINDOW_BYTES,
    text_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """Each row of ``df`` as struct ``row``, with word counts, items found and spans of the hits."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_column}`").cast("string"), F.lit("null")).alias("item"),
        utf8(F.col(f"`{item_text_column}`")).alias("text"),
    )
    windows = items.mapInArrow(_item_windows(window_words), "item string, window binary")
    folder, blocks = _store_windows(windows, window_bytes)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _automaton(folder, 0) if blocks == 1 else None
        # With one automaton a batch can go as soon as it is scanned.
        for portion in _portions(batches, text_bytes if blocks > 1 else 1):
            texts = [texts_of(batch, text_column).to_pylist() for batch in portion]
            found = [[(len(words_of(t)), set(), set()) for t in batch] for batch in texts] if blocks != 1 else [
                [scan(t, only) for t in batch] for batch in texts
            ]
            for block in range(blocks if blocks > 1 else 0):
                automaton = _automaton(folder, block)
                for results, batch in zip(found, texts, strict=True):
                    for (_, hits, items_), text in zip(results, batch, strict=True):
                        _, hit, names = scan(text, automaton)
                        hits |= hit
                        items_ |= names
            for batch, results, lines in zip(portion, found, texts, strict=True):
                yield rows_of(batch, results, lines)

    def rows_of(batch: pa.RecordBatch, found: list[tuple[int, set[int], set[str]]], texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                batch[ROW],
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([len(f[1]) for f in found], pa.int64()),
                pa.array([len(f[2]) for f in found], pa.int64()),
                pa.array([sha256_hex(",".join(sorted(f[2])).encode()) for f in found], pa.string()),
                pa.array(
                    [hit_spans(t, f[1]) if f[1] else [] for t, f in zip(texts, found, strict=True)],
                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                ),
            ],
            [ROW, "n_words", "n_hit", "n_items", "items_sha256", "spans"],
        )

    rows = small_batches(df).select(whole_row(df))
    return rows.mapInArrow(tidy(scanned), T.StructType([rows.schema[ROW], *T.StructType.fromDDL(_RESULT)]))


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` that hold no window of the benchmark, with the columns of ``df``."""
    marked = mark_contaminated(df, benchmark)
    return marked.where("n_hit = 0").select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in df.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.select(
        f"{ROW}.doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, p, p + least(len(w), 10) - 1) AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM win),
cut AS (
  SELECT r, p, size, list_slice(w, p, p + size - 1) AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
),
hits AS (SELECT r, p, cut.size AS size, item FROM cut JOIN win USING (words)),
words AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r
),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
