"""Operator 1: secret scans through a trigram inverted index. Spark functions only.

For each rule a Boolean trigram query is derived from its regular expression: any of several branches, each
a set of trigrams that must all occur. Postings (trigram, document) are intersected per branch; only
candidates are verified by the expression. A rule from which no trigram follows scans all documents.
The index is on lower-cased text, so it finds a superset whatever the case.

Null and empty texts have no spans. Rows repeated in full have the same spans each. An empty table gives no rows.
Extra columns are not read. Nothing limits the length of texts or the number of spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import read_table
from larkspur.session import materialise

# Branches of a query; a rule with more of them scans all documents, which finds the same.
MAX_BRANCHES = 64
# Matches whose offsets are added up in one go.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """A secret is a match of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # The same runs as [0-9a-f]+ with 16 characters or more, without listing the short ones.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
)


def _strings(tokens) -> list[list[frozenset[str] | None]]:
    """The alternatives of an expression, each a sequence of character sets; None is a gap of any text."""
    branches: list[list[frozenset[str] | None]] = [[]]
    for op, value in tokens:
        if op is sre.LITERAL:
            parts = [[frozenset(chr(value).lower())]]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            parts = [[frozenset(chr(v).lower() for _, v in value)]]
        elif op is sre.SUBPATTERN:
            parts = _strings(value[3])
        elif op is sre.BRANCH:
            parts = [s for alternative in value[1] for s in _strings(alternative)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            once = _strings(inner)
            if most == 1:
                parts = [[], *once]
            else:
                parts = [[*reduce(lambda a, b: a + b, [s] * least, []), None] for s in once]
        else:
            parts = [[None]]
        branches = [a + b for a, b in product(branches, parts)]
        if len(branches) > MAX_BRANCHES:
            return [[None]]
    return branches


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, of which one set must occur as a whole in any text that matches; empty if none follows."""
    query: set[frozenset[str]] = set()
    for sequence in _strings(_parser.parse(pattern)):
        needed = set()
        for window in zip(sequence, sequence[1:], sequence[2:], strict=False):
            if None not in window and all(len(s) == 1 for s in window):
                needed.add("".join(next(iter(s)) for s in window))
        if not needed:
            return []
        query.add(frozenset(needed))
    # A branch that contains another one adds nothing.
    return sorted((q for q in query if not any(o < q for o in query)), key=sorted)


def _key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def trigram_postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """One row per document and trigram of ``trigrams`` that its lower-cased text holds."""
    lowered = texts.select(*_key(), F.lower("text").alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("doc_id", "text_hash", F.explode(held).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """The documents whose postings meet a branch of a rule, with the kinds of the rules they meet."""
    spark = postings.sparkSession
    branches = [(kind, i, t, len(b)) for kind, query in queries.items() for i, b in enumerate(query) for t in b]
    plan = spark.createDataFrame(branches, "kind string, branch int, trigram string, needed int")
    # The plan has a row per rule, branch and trigram; its size is that of the rule list.
    met = (
        postings.join(F.broadcast(plan), "trigram")
        .groupBy("doc_id", "text_hash", "kind", "branch", "needed")
        .agg(F.count("*").alias("found"))
        .where("found = needed")
    )
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule) -> Column:
    """The rule's matches as structs of start, end and kind, in code points, end exclusive.

    The pieces between the matches and the matches themselves interleave, so sums of their lengths are
    the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    steps = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), F.transform(tested, F.length).alias("tested"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + F.coalesce(step["size"], F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = F.coalesce(step["tested"] >= rule.least, F.lit(False))
        spans = F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    # An array that grows by a span is copied for each; so spans are gathered in runs, and runs as wholes.
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")),
        lambda r: F.aggregate(
            F.slice(steps, r * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("spans")), add
        ),
    )

    def shifted(state: Column, run: Column) -> Column:
        moved = F.transform(
            run["spans"],
            lambda s: F.struct(
                (s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["kind"].alias("kind")
            ),
        )
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["runs"], F.array(moved)).alias("runs"))

    whole = F.struct(F.lit(0).alias("at"), F.array(empty).alias("runs"))
    spans = F.aggregate(runs, whole, shifted, lambda s: F.flatten(s["runs"]))
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def find_secrets(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``df``: ``doc_id`` and ``spans``, an array of (start, end, kind) by start and rule."""
    texts = df.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    kinds: Column = F.array().cast("array<string>")
    if indexed:
        trigrams = sorted(set().union(*[b for q in indexed.values() for b in q]))
        index = materialise(trigram_postings(texts, trigrams), "trigrams")
        hits = candidates(index, indexed).select(
            F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kinds"
        )
        texts = texts.withColumn("text_hash", F.xxhash64("text"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        texts = texts.join(hits, same, "left")
        kinds = F.coalesce("kinds", kinds)
    parts = []
    for place, rule in enumerate(rules):
        spans = F.transform(
            rule_spans(F.col("text"), rule),
            lambda s, place=place: F.struct(
                s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")
            ),
        )
        if rule.kind in indexed:
            empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
            spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(empty)
        parts.append(spans)
    ordered = F.transform(
        F.array_sort(F.concat(*parts)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return texts.select("doc_id", ordered.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for place, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, {place} AS place, '{rule.kind}' AS kind,
         list_sum(list_slice(gaps, 1, i)) + coalesce(list_sum(list_slice(sizes, 1, i - 1)), 0) AS start, sizes[i] AS size
  FROM (SELECT r, gaps, sizes, tested, unnest(range(1, len(sizes) + 1)) AS i FROM (
    SELECT r, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS gaps,
           list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) AS sizes,
           list_transform(regexp_extract_all(text, '{pattern}', {rule.group}), lambda x: length(x)) AS tested FROM t
  )) WHERE tested[i] >= {rule.least}""")
    listed = "string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place)"
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    named = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {counts}, {listed} FILTER (kind IN ({base})) AS base, {listed} AS spans FROM s GROUP BY r)
SELECT doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""


SQL = _sql()


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str]]:
    """The same spans of one text by the expressions alone; for tests."""
    found = [
        (m.start(), place, m.end(), rule.kind)
        for place, rule in enumerate(rules)
        for m in re.finditer(rule.pattern, text)
        if len(m[rule.group]) >= rule.least
    ]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]
