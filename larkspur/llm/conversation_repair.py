"""Operator 12: repair of a conversation's structure by Wagner-Fischer alignment to an alternating grammar.

A repaired conversation reads ``(s?(ua)+)?`` by its turns' first letters. Turns are kept, given another role, deleted or
inserted; the cheapest edits win, of equally cheap ones those whose initials come first in ASCII order.

A conversation is cut into blocks of ``BLOCK`` turns. What the grammar allows next is one of four states, so a block is
aligned once per state that it may be entered in and left in. For each feasible length of the grammar's string between
two states, the block's turns are aligned to that string: a Wagner-Fischer table of costs to the end, kept to the Ukkonen
band of cells that can still reach the incumbent cost, and a backtrace from its start that takes the least letter
among the cheapest moves. The lengths are tried from the block's own outwards, until changing the length alone costs more than the
incumbent; audits of equal cost are compared. A block's string ends with one of its turns, so no audit is the beginning of
another one. Blocks of a conversation are then joined by their costs, which gives the alignment of the
whole conversation to the best of all feasible lengths. A conversation of any length is thus aligned in many
tasks; only costs and audits of its blocks meet in one, and its text passes through one task in order, without
being held, as its digest has to be taken in order.

Rows are ordered by turn, null first, then role and text. Null roles and texts are one space, and so are null ids in the
damage's hash; rows without a conversation id are a conversation of their own. Repeated rows are duplicates. Long texts
count whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import batches_of, read_table, stored
from larkspur.operators.ordering import running_totals

BLOCK = 32
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
# White space, as a class of a regular expression.
_SPACE = r"\x20\x09-\x0D"
_LEGAL = {"su", "ua", "au"}

# What the grammar allows next: anything (nothing was said), a user after the system, an assistant, a user after an assistant.
START, FIRST_USER, ASSISTANT, USER = range(4)
# What closes a conversation in each state.
_CLOSING = {START: "", FIRST_USER: "II", ASSISTANT: "I", USER: ""}
# Turns as a block is aligned by: first letter (x: none of the grammar's) and flag.
FINE, BROKEN, DOOMED = ".", "t", "-"


def damaged(df: DataFrame) -> DataFrame:
    """``df`` as conv_id, turn, role, text with a hash of conversation and turn deciding what befalls a row."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat_ws(":", *names).cast("binary")) % 20
    return (
        df.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate"))
        .where("fate <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def _targets(entry: int, leave: int, n: int, most: int) -> Iterator[str]:
    """The grammar's strings from one state to another, nearest to length ``n`` first, while the length alone costs ``most`` at most."""

    def string(length: int) -> str | None:
        if length == 0:
            return "" if leave == entry else None
        if leave == FIRST_USER:
            return "s" if (entry, length) == (START, 1) else None
        if leave == START:
            return None
        if entry == ASSISTANT:
            out = ("au" * length)[:length]
        elif entry == START and (length % 2 == 0) == (leave == ASSISTANT):
            # An even string that ends with a user, or an odd one that ends with an assistant, opens with the system.
            out = "s" + ("ua" * length)[: length - 1]
        else:
            out = ("ua" * length)[:length]
        last = "u" if leave == ASSISTANT else "a"
        return out if out[-1] == last else None

    lengths = [*range(n, n + most // INSERT + 1), *range(n - 1, max(n - most // DELETE, 0) - 1, -1)]
    for length in sorted(lengths, key=lambda x: abs(x - n)):
        target = string(length)
        if target is not None:
            yield target


def _shift_cost(shift: int) -> int:
    return shift * INSERT if shift > 0 else -shift * DELETE


def banded_alignment(initials: str, flags: str, target: str, most: int) -> tuple[int, str] | None:
    """Cheapest edits of turns into ``target`` that end with a turn, least audit, if they cost ``most`` at most."""
    n, m = len(initials), len(target)
    if n == 0:
        return (0, "") if m == 0 else None
    # Ukkonen's band: a cell off the diagonal by d needs at least the shifts to d and from d to the end.
    band = [d for d in range(-n, m + 1) if _shift_cost(d) + _shift_cost(m - n - d) <= most]
    if not band or band[0] > 0 or band[-1] < 0:
        return None
    low, high = band[0], band[-1]
    far = most + 1
    costs = [[far] * (m + 1) for _ in range(n + 1)]
    costs[n][m] = 0

    def moves(i: int, j: int) -> Iterator[tuple[str, int, int, int]]:
        """Edit, cost with the rest, next cell; in ASCII order of the edits."""
        yield "D", DELETE + costs[i + 1][j], i + 1, j
        if j < m:
            if target[j] != "s":
                yield "I", INSERT + costs[i][j + 1], i, j + 1
            if flags[i] != DOOMED:
                rest = costs[i + 1][j + 1] + (TRUNCATED if flags[i] == BROKEN else 0)
                if initials[i] == target[j]:
                    yield "K", rest, i + 1, j + 1
                if target[j] != "s":
                    yield "R", REROLE + rest, i + 1, j + 1

    for i in range(n - 1, -1, -1):
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            costs[i][j] = min(far, *(cost for _, cost, _, _ in moves(i, j)))
    if costs[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n:
        best = costs[i][j]
        edit, _, i, j = next(move for move in moves(i, j) if move[1] == best)
        audit.append(edit)
    return costs[0][0], "".join(audit)


@lru_cache(maxsize=20_000)
def align_block(initials: str, flags: str, entry: int) -> tuple[tuple[int, str] | None, ...]:
    """Per state that the block can be left in the cheapest cost and its least audit."""
    out = []
    for leave in range(4):
        n = len(initials)
        # Deleting all turns and inserting what leads from one state to the other costs no more, where that is possible at all.
        best, cost = None, n * DELETE + 2 * INSERT
        for target in _targets(entry, leave, n, cost):
            if _shift_cost(len(target) - n) > cost:
                continue
            found = banded_alignment(initials, flags, target, cost)
            if found is not None and (best is None or found < best):
                best, cost = found, found[0]
        out.append(best)
    return tuple(out)


_PAIR = "struct<cost:int,audit:string>"
_BLOCK_OUT = f"conv string, block bigint, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, ways array<array<{_PAIR}>>"
_EDITS_OUT = "conv string, block bigint, audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_RESULT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _schema(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(name, types[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block what holds of it and its alignments by state of entry and exit."""
    pair = pa.struct([("cost", pa.int32()), ("audit", pa.string())])
    plain = _schema(_BLOCK_OUT.split(", ways")[0])
    schema = plain.append(pa.field("ways", pa.list_(pa.list_(pair))))

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                turns = row["rows"]
                raw = [t["initial"] for t in turns]
                initials = "".join(c if c and c in "sua" else "x" for c in raw)
                flags = "".join(t["flag"] for t in turns)
                numbers = [t["turn"] for t in turns if t["turn"] is not None]
                # The first block is entered at the start, and so is one after blocks that were deleted whole.
                entries = [START] if row["block"] == 0 else range(4)
                ways = [
                    [w and {"cost": w[0], "audit": w[1]} for w in align_block(initials, "".join(DOOMED if f in "bd" else f for f in flags), e)]
                    if e in entries else [] for e in range(4)
                ]
                yield {
                    "conv": row["conv"], "block": row["block"],
                    "first_turn": min(numbers, default=None), "last_turn": max(numbers, default=None),
                    "turns": len(set(numbers)),
                    "blank": flags.count("b"), "duplicate": flags.count("d"), "truncated": flags.count(BROKEN),
                    "illegal": sum(a + b not in _LEGAL for a, b in zip(raw, raw[1:])),
                    "first": raw[0], "last": raw[-1], "ways": ways,
                }

    yield from batches_of(rows(), schema, 500)


class _Conversation:
    """The best way through the blocks of one conversation, fed in order."""

    def __init__(self, conv: str) -> None:
        self.conv = conv
        # Per reachable state its cost; ``ranks`` orders the audits that lead to the states.
        self.costs, self.ranks = {START: 0}, {START: 0}
        # Per block and state of exit the state of entry and the audit.
        self.steps: list[dict[int, tuple[int, str]]] = []
        self.sums = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = self.last_initial = None

    def add(self, block: dict) -> None:
        for name in self.sums:
            self.sums[name] += block[name]
        if block["first_turn"] is not None:
            if self.first is None:
                self.first = block["first_turn"]
            elif block["first_turn"] == self.last:
                self.sums["turns"] -= 1
            self.last = block["last_turn"]
        if self.steps and self.last_initial + block["first"] not in _LEGAL:
            self.sums["illegal"] += 1
        self.last_initial = block["last"]
        best: dict[int, tuple[int, int, str, int]] = {}
        for entry, cost in self.costs.items():
            for leave, way in enumerate(block["ways"][entry]):
                if way is not None:
                    found = (cost + way["cost"], self.ranks[entry], way["audit"], entry)
                    if leave not in best or found < best[leave]:
                        best[leave] = found
        self.costs = {leave: found[0] for leave, found in best.items()}
        order = sorted(best, key=lambda leave: best[leave][1:3])
        self.ranks = {leave: rank for rank, leave in enumerate(order)}
        self.steps.append({leave: (found[3], found[2]) for leave, found in best.items()})

    def edits(self) -> Iterator[dict]:
        """A row per block with its part of the audit and what holds of the conversation."""
        cost, _, state = min((c + INSERT * len(_CLOSING[s]), self.ranks[s], s) for s, c in self.costs.items())
        parts = [_CLOSING[state]]
        for step in reversed(self.steps):
            state, audit = step[state]
            parts.append(audit)
        closing, *parts = parts
        parts.reverse()
        parts[-1] += closing
        turns = self.sums.pop("turns")
        gaps = 0 if self.first is None else self.last - self.first + 1 - turns
        for block, audit in enumerate(parts):
            yield {"conv": self.conv, "block": block, "audit": audit, "gaps": gaps, "cost": cost, **self.sums}


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        current = None
        for batch in batches:
            for block in batch.to_pylist():
                if current is None or block["conv"] != current.conv:
                    if current is not None:
                        yield from current.edits()
                    current = _Conversation(block["conv"])
                current.add(block)
        if current is not None:
            yield from current.edits()

    yield from batches_of(rows(), _schema(_EDITS_OUT))


class _Repair:
    """A repaired conversation's digest, fed with the edits and turns of its blocks in order."""

    def __init__(self) -> None:
        self.digest = hashlib.sha256()
        self.parts: list[str] = []
        self.state = START
        self.edits = iter("")
        self.empty = True

    def line(self, role: str, text: str, initial: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False
        self.state = {"s": FIRST_USER, "u": ASSISTANT, "a": USER}[initial]

    def wanted(self) -> str:
        return "assistant" if self.state == ASSISTANT else "user"

    def inserted(self) -> str | None:
        """Say what is inserted; the first edit after it, if there is one."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.line(self.wanted(), "", self.wanted()[0])
        return None

    def block(self, audit: str) -> None:
        self.inserted()
        self.parts.append(audit)
        self.edits = iter(audit)

    def turn(self, role: str, text: str) -> None:
        edit = self.inserted()
        if edit == "K":
            self.line(role, text, role[0])
        elif edit == "R":
            self.line(self.wanted(), text, self.wanted()[0])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the edits of each block to its turns; the row of edits comes before the turns."""
    names = _RESULT.split(", ")

    def rows() -> Iterator[dict]:
        result, repair = None, None

        def finished() -> dict:
            repair.inserted()
            return {**result, "audit": "".join(repair.parts), "repaired_sha256": repair.digest.hexdigest()}

        for batch in batches:
            for row in batch.to_pylist():
                if row["audit"] is None:
                    repair.turn(row["role"], row["text"])
                    continue
                if result is None or row["conv"] != result["conv"]:
                    if result is not None:
                        yield finished()
                    result, repair = {n.split()[0]: row.get(n.split()[0]) for n in names}, _Repair()
                repair.block(row["audit"])
        if result is not None:
            yield finished()

    yield from batches_of(rows(), _schema(_RESULT))


def _flag(seen: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated or none."""
    visible = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    return (
        F.when(visible == "", "b").when(seen, "d").when(visible.rlike(r"[.!?]"), FINE).otherwise(BROKEN)
    )


def repair_conversations(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text without nulls in the last two): faults and the cheapest repair."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = df.select(conv.alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    # Numbers make the order unique, so a slice boundary can lie anywhere; equal rows are interchangeable.
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "turns")
    placed = running_totals(numbered, ["conv"], ["turn", "role", "text", "_row"], {"place": F.lit(1).cast("bigint")})
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    placed = placed.select(
        "conv", "place", F.expr(f"place div {block}").alias("block"), "turn", "role", "text",
        F.unhex(F.sha2(content, 256)).alias("content"),
    )
    placed = stored(placed, "placed")
    first = placed.groupBy("conv", "content").agg(F.min("place").alias("place")).withColumn("new", F.lit(True))
    flags = placed.select(
        "conv", "content", "place", "block", "turn", F.substring("role", 1, 1).alias("initial"),
        _flag(F.lit(False)).alias("flag"),
    ).join(first, ["conv", "content", "place"], "left")
    flag = F.when((F.col("flag") != "b") & F.col("new").isNull(), "d").otherwise(F.col("flag"))
    blocks = flags.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("place", "turn", "initial", flag.alias("flag")))).alias("rows")
    )
    aligned = blocks.mapInArrow(_align, _BLOCK_OUT)
    edits = (
        aligned.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_join_blocks, _EDITS_OUT)
    )
    none = F.lit(None)
    said = placed.select("conv", "block", "place", "role", "text")
    told = edits.withColumns({"place": F.lit(-1).cast("bigint"), "role": none.cast("string"), "text": none.cast("string")})
    return (
        told.unionByName(said, allowMissingColumns=True)
        .repartition("conv").sortWithinPartitions("conv", "block", "place")
        .mapInArrow(_digested, _RESULT)
    )


def repaired_after_damage(df: DataFrame) -> DataFrame:
    """One row per conversation of ``df`` before the damage."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    everyone = df.select("conv_id", conv.alias("conv")).distinct()
    result = repair_conversations(damaged(df))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return everyone.join(result, "conv", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_after_damage(read_table(spark, sf_dir, "conversations"))
