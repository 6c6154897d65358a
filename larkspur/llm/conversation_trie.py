"""Operator 13: a prefix trie of conversations by truncation peeling.

Each conversation is first rebuilt: it opens with the first turns of a shared conversation and goes on with its own. A
node of the trie is a distinct sequence of turns that some rebuilt conversation starts with.

The trie is built from its deepest level up. A round takes the nodes that survived the rounds below, adds the
conversations that end at its depth and groups both by the sequence that is left: one aggregate finds the nodes of the depth
and, from the sums their children carry, all values of their subtrees. Then a survivor's last turn is stripped, again and
again while it meets nothing it could merge with, and it is kept for the round where it does. Depths at which nothing merges need no round:
how many different conversations pass through a node is counted first, and that number changes only where paths meet. A
conversation with a long tail of its own is thus peeled in its task, and the rounds are the depths where conversations part or end.
A node is known by a SHA-256 chained over its turns, so no text is shuffled. Equal conversations are one from
the start, and hot prefixes are summed before the shuffle. Rounds are written to the shared folder. A conversation's
digests, 40 bytes a turn, are one row.

Turns are ordered by number, null first, then by role and by the digest of role and text; repeated rows are turns of
their own. A null role or text is empty, and long texts count whole. Rows without a conversation id belong to
no conversation and are left out. Without conversations there are no nodes, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import batches_of, read_table, stored
from larkspur.session import scratch_path

# Turns that a conversation takes over: a hash of its id modulo this; the conversation it takes them from is the
# first of its block of ids.
SHARED_TURNS = 6
BLOCK_IDS = 100
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_TURNS = "array<struct<key:binary,chars:bigint>>"
_CHAINS = f"conv_id bigint, chain {_TURNS}"
_ENDS = "key binary, ends_sha256 string"
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
# Finished nodes lie in the folder of depth -1, survivors in that of the depth where they merge.
_PEELED = (
    "depth bigint, key binary, up binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    f"saved_tokens bigint, chain {_TURNS}, stops array<int>"
)
_FINISHED = -1


def rebuilt_conversations(df: DataFrame, shared: int = SHARED_TURNS, block: int = BLOCK_IDS) -> DataFrame:
    """Per conversation id its rebuilt ``turns``, as digest of role and text with the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length keeps ("a", "bc") apart from ("ab", "c").
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )
    conv_id = F.col("conv_id").cast("bigint")
    grouped = (
        df.where(conv_id.isNotNull())
        .select(conv_id.alias("conv_id"), turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["chars"])).alias("turns"))
    )
    # Both sides of the join read the groups; they are narrow and written once.
    groups = stored(grouped, "conversations")
    # A shared conversation is joined by the ids of its block, a fixed number, with a fixed number of turns.
    heads = groups.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, shared).alias("_head")
    )
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    own = F.slice("turns", taken + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), taken)
    joined = groups.join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("_base"), "left")
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


_NODE = pa.struct([("key", pa.binary()), ("chars", pa.int64())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the key of each of its prefixes, the textless one first."""
    schema = pa.schema([("conv_id", pa.int64()), ("chain", pa.list_(_NODE))])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                key = hashlib.sha256(b"").digest()
                chain = [{"key": key, "chars": 0}]
                for turn in row["turns"]:
                    key = hashlib.sha256(key + turn["digest"]).digest()
                    chain.append({"key": key, "chars": turn["chars"]})
                yield {"conv_id": row["conv_id"], "chain": chain}

    yield from batches_of(rows(), schema, 500)


def _digest_of_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each key; ids arrive in order, and only the running hash is kept."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def rows() -> Iterator[dict]:
        key, state = None, None
        for batch in batches:
            for k, conv_id in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if k == key:
                    state.update(f",{conv_id}".encode())
                    continue
                if state is not None:
                    yield {"key": key, "ends_sha256": state.hexdigest()}
                key, state = k, hashlib.sha256(str(conv_id).encode())
        if state is not None:
            yield {"key": key, "ends_sha256": state.hexdigest()}

    yield from batches_of(rows(), schema)


def _last(name: str) -> Column:
    return F.element_at("chain", -1)[name]


def stops_of(passing: dict[int, int], length: int) -> list[int]:
    """Depths where the number of different conversations that pass through changes; ``passing`` has those of two and more."""
    through = [passing.get(depth, 1) for depth in range(length + 1)] + [0]
    return [d for d in range(length + 1) if through[d] > 1 and through[d] != through[d + 1]]


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strip nodes turn by turn up to where they merge: a row per node on the way, and the survivor."""
    schema = pa.schema([
        ("depth", pa.int64()), ("key", pa.binary()), ("up", pa.binary()), ("conv_id", pa.int64()),
        *[(name, pa.int64()) for name in _SUMS], ("chain", pa.list_(_NODE)), ("stops", pa.list_(pa.int32())),
        ("at", pa.int64()),
    ])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                chain, stops = row["chain"], row["stops"]
                depth = len(chain) - 1
                if not row["merged"] and stops and stops[-1] == depth:
                    yield {**row, "depth": depth, "at": depth}
                    continue
                stops = [d for d in stops if d < depth]
                end = stops[-1] if stops else -1
                sums = {name: row[name] for name in _SUMS}
                sums["n_leaves"] = max(sums["n_leaves"], 1)
                for d in range(depth, end, -1):
                    sums["saved_tokens"] += (sums["n_convs"] - 1) * chain[d]["chars"]
                    up = chain[d - 1]["key"] if d else None
                    yield {"depth": d, "key": chain[d]["key"], "up": up, "conv_id": row["conv_id"], **sums, "at": _FINISHED}
                    sums["n_children"] = 1
                if stops:
                    yield {"depth": end, "conv_id": row["conv_id"], **sums, "chain": chain[: end + 1], "stops": stops, "at": end}

    yield from batches_of(rows(), schema, 500)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node, from rows with ``conv_id`` and ``turns``, the latter as digests with code points.

    A digest stands for a turn, so conversations are the same where their SHA-256 chains are.
    """
    spark = conversations.sparkSession
    zero = F.lit(0).cast("bigint")
    chains = stored(conversations.mapInArrow(_chained, _CHAINS), "chains")
    # Different conversations, each with its number of copies.
    ended = chains.withColumn("last", _last("key")).groupBy("last").agg(
        F.min(F.struct("conv_id", "chain")).alias("least"), F.count("*").alias("n_convs")
    )
    ended = stored(ended.select("last", "least.*", "n_convs"), "different")
    # All of them pass through the root, so only nodes below it have to be counted.
    through = ended.select("last", F.posexplode("chain").alias("depth", "node")).where("depth > 0")
    through = through.select("last", "depth", F.col("node.key").alias("key"))
    shared = through.groupBy("key").agg(F.count("*").cast("int").alias("passing")).where("passing > 1")
    paths = through.join(shared, "key").groupBy("last").agg(F.collect_list(F.struct("depth", "passing")).alias("passing"))
    everyone = ended.count()

    def with_stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("last", pa.binary()), ("length", pa.int32()), ("stops", pa.list_(pa.int32()))])

        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    passing = {p["depth"]: p["passing"] for p in row["passing"] or []}
                    stops = stops_of({0: everyone, **passing}, row["length"])
                    yield {"last": row["last"], "length": row["length"], "stops": stops}

        yield from batches_of(rows(), schema)

    lengths = ended.select("last", (F.size("chain") - 1).alias("length")).join(paths, "last", "left")
    stops = stored(lengths.mapInArrow(with_stops, "last binary, length int, stops array<int>"), "stops")
    entries = ended.join(stops.drop("length"), "last").select(
        "conv_id", "chain", "stops", F.lit(False).alias("merged"), "n_convs",
        *[zero.alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
    )
    path = scratch_path(spark, "peeled")

    def peel(nodes: DataFrame) -> None:
        nodes.mapInArrow(_peeled, f"{_PEELED}, at bigint").write.partitionBy("at").mode("append").parquet(path)

    peel(entries)
    depths = [r[0] for r in stops.select(F.explode("stops").alias("depth")).distinct().orderBy(F.desc("depth")).collect()]
    for depth in depths:
        survivors = spark.read.schema(_PEELED).parquet(f"{path}/at={depth}")
        merged = survivors.groupBy(_last("key").alias("key")).agg(
            F.min(F.struct("conv_id", "chain", "stops")).alias("least"), *[F.sum(c).alias(c) for c in _SUMS]
        )
        peel(merged.select("least.*", F.lit(True).alias("merged"), *_SUMS))
    finished = spark.read.schema(_PEELED).parquet(f"{path}/at={_FINISHED}") if everyone else spark.createDataFrame([], _PEELED)
    nodes = finished.drop("chain", "stops")
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    ends = (
        chains.select(_last("key").alias("key"), "conv_id")
        .repartition("key").sortWithinPartitions("key", "conv_id")
        .mapInArrow(_digest_of_ends, _ENDS)
    )
    return nodes.join(parents, "up", "left").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", *_SUMS, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_conversations(read_table(spark, sf_dir, "conversations")))


# CRC-32 by table, as the database has none.
SQL = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % {BLOCK_IDS} AS base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)]))) % {SHARED_TURNS} AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT c.conv_id, place, role, text FROM c JOIN n ON n.conv_id = base AND place <= h
  UNION ALL
  SELECT c.conv_id, place + 1000000, role, text FROM c JOIN n ON n.conv_id = c.conv_id AND place > h
), b AS (
  SELECT c.conv_id, list({{'r': role, 't': text}} ORDER BY place) FILTER (role IS NOT NULL) AS turns
  FROM c LEFT JOIN r USING (conv_id) GROUP BY ALL
), p AS (
  SELECT conv_id, d, len(coalesce(turns, [])) AS n, coalesce(turns, [])[1:d] AS prefix, turns[d].t AS last
  FROM (SELECT *, unnest(range(0, len(coalesce(turns, [])) + 1)) AS d FROM b)
), g AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM p GROUP BY d, prefix
), k AS (
  SELECT g.d, g.prefix, count(x.d) AS n_children FROM g LEFT JOIN g x ON x.d = g.d + 1 AND x.prefix[1:g.d] = g.prefix
  GROUP BY ALL
), m AS (SELECT g.*, n_children FROM g JOIN k USING (d, prefix))
SELECT m.conv_id, m.d AS depth, any_value(u.conv_id) AS parent_conv_id, m.n_convs, m.n_children,
       count(*) FILTER (s.n_children = 0) AS n_leaves,
       CAST(coalesce(sum((s.n_convs - 1) * length(s.last)), 0) AS BIGINT) AS saved_tokens,
       sha256(m.ends) AS ends_sha256
FROM m JOIN m s ON s.d >= m.d AND s.prefix[1:m.d] = m.prefix
LEFT JOIN m u ON u.d = m.d - 1 AND m.prefix[1:m.d - 1] = u.prefix
GROUP BY m.d, m.prefix, m.conv_id, m.n_convs, m.n_children, m.ends
"""
