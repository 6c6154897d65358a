"""Operator 11: main text of web pages by templates deduced from equivalence classes of tokens.

Pages of one host come from few templates. A token is a tag or a block of text together with its path of elements; its
occurrence vector says how often each page of the host has it. Tokens with equal vectors form a class, as the parts of
one template do. A class is valid if its tokens come in one fixed order, again and again, on the pages that have it,
and if it lies in one and the same slot of another valid class or of none; nested in each other, the valid
classes are the template of the host, and what lies between their tokens are its slots. The main text is what fills the slots
below the template's article. On pages without one it is what fills the deepest element of the template that
holds two thirds of the text of such pages. Text that is a token of the template itself, on all of at least ``TEXT_PAGES`` pages,
is no content, unless it makes up half of the main text, as in copies of one page.

The vectors are never built: the sum of a random number per page, times the occurrences there, modulo a prime, stands for
one, so classes come from one aggregate per host and token, and a host may have any number of pages. A host's table has no
more tokens than a fixed multiple of what an average page of it has, as a token must be on a twentieth of its pages.
The pages are joined with it by host; Spark broadcasts it where it is small and else splits hot hosts.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers are known by the names
of elements, classes, ids and roles, and never yield text. An article's own header belongs to it.

Pages without an address, of hosts with fewer than ``PAGES`` pages, and those without the article of their host's template are
their own template, by the same rules. A null or empty page has no text. Pages are read whole; repeated pages are pages of
their own, and so are rows with a null or repeated id. Broken markup is read as browsers read it: an open comment, quote or script
reaches to the end. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import batches_of, read_table, stored

# Pages that a host's template needs, the share of pages that a token needs, and the share that may break a class.
PAGES = 3
SUPPORT = 0.05
TOLERANCE = 0.05
# A template's own text must be on this many pages, all of the host, and be no more than this share of its main text.
TEXT_PAGES = 8
TEXT_SHARE = 0.5
# The share of a host's text that its main element holds.
MAIN_SHARE = 2 / 3
_PRIME = (1 << 61) - 1
_COUNTED = 20_000

# Fixed names of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea iframe noembed noframes xmp title".split())
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "search section select summary table tbody td template tfoot th thead tr ul".split()
)
# An element that ends those given if it starts in them.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
_CONTAINERS = set("article body center div header html main section".split())
_NO_TEXT = set(
    "head nav aside footer menu form fieldset button select textarea dialog noscript iframe object svg canvas video audio "
    "script style template datalist noembed noframes xmp title search math".split()
)
_NO_TEXT_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget toolbar pagination pager comment comments commentlist "
    "respond disqus replies copyright".split()
)
_COMMENT_WORDS = set("comment comments commentlist respond disqus replies reply".split())
_NO_TEXT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())

_MARKUP = re.compile(
    r"<(?:!--(?:-?>|.*?-->|.*)"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z))",
    re.S,
)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Roles: parts of content, elements that may hold the main text by its share alone, and those named for it.
INNER, PLAIN, MAIN, ARTICLE = range(-1, 3)


@lru_cache(maxsize=20_000)
def _element(name: str, names: tuple[tuple[str, str], ...]) -> tuple[str, int, bool, bool]:
    """An element's label in paths, its role, whether it never holds text, and whether it is a page's header."""
    words, role, label = set(), "", name
    for kind, value in names:
        if kind == "role":
            role = value.strip().lower()
        words.update(w.lower() for w in _WORD.findall(value))
        label += f" {kind}={re.sub(r'[0-9]+', '#', value)}"
    if name in ("html", "body"):
        return label, PLAIN, False, False
    if name == "article" or name == "main" or role in ("article", "main"):
        kind = ARTICLE if "article" in (name, role) else MAIN
        return label, kind, kind == ARTICLE and bool(words & _COMMENT_WORDS), False
    without = name in _NO_TEXT or role in _NO_TEXT_ROLES or bool(words & _NO_TEXT_WORDS)
    kind = PLAIN if name in _CONTAINERS else INNER
    return label, kind, without, name == "header" or (kind == PLAIN and "header" in words)


class Page:
    """A page's elements, tokens and blocks of text, in order."""

    def __init__(self, source: str) -> None:
        # By element: token, index of the parent, role, depth, and characters below it that are no link's.
        self.elements: list[int] = [0]
        self.parents: list[int] = [0]
        self.roles: list[int] = [PLAIN]
        self.depths: list[int] = [0]
        self.chars: list[int] = [0]
        self.tokens: list[int] = []
        # Text, its token and its element.
        self.blocks: list[tuple[str, int, int]] = []
        self._read(source)
        for i in range(len(self.parents) - 1, 0, -1):
            self.chars[self.parents[i]] += self.chars[i]
        for role in (ARTICLE, MAIN):
            named = [i for i, r in enumerate(self.roles) if r == role]
            # Articles that hold little of the text are teasers or the like.
            if 2 * sum(self.chars[i] for i in named) < self.chars[0]:
                for i in named:
                    self.roles[i] = PLAIN

    def _read(self, source: str) -> None:
        # Open elements: name, index, whether text in it counts, whether it lies in an article or main element.
        stack: list[tuple[str, int, bool, bool]] = [("", 0, True, False)]
        names = Counter()
        said: list[str] = []
        links = linked = 0

        def end_block() -> None:
            nonlocal linked
            if said:
                text = " ".join("".join(said).split())
                if text:
                    at = stack[-1][1]
                    token = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.elements[at]) >> 1 | 1
                    self.tokens.append(token)
                    self.blocks.append((text, token, at))
                    self.chars[at] += max(len(text) - linked, 0)
                said.clear()
            linked = 0

        def close(name: str) -> None:
            while True:
                last, at, _, _ = stack.pop()
                names[last] -= 1
                # The token that ends an element is its own, with other bits.
                self.tokens.append(self.elements[at] ^ 0x5A5A5A5A)
                if last == name:
                    return

        at, size = 0, len(source)
        while at < size:
            found = _MARKUP.search(source, at)
            if stack[-1][2]:
                piece = source[at : found.start() if found else size]
                if piece:
                    said.append(html.unescape(piece))
                    linked += len(piece) if links else 0
            if found is None:
                break
            at = found.end()
            ending, name, attributes = found.groups()
            if name is None:
                continue
            name = name.lower()
            if ending:
                if name == "a":
                    links = max(links - 1, 0)
                if names[name] > 0:
                    if name in _BLOCK:
                        end_block()
                    close(name)
                continue
            if name == "a":
                links += 1
            elif name == "br":
                said.append(" ")
            if name in _VOID:
                if name == "hr":
                    end_block()
                continue
            known = tuple((k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ()
            label, role, without, header = _element(name, known)
            block = name in _BLOCK
            if block:
                end_block()
                if names["p"]:
                    # A paragraph ends where a block starts in it, also in other elements of a line.
                    above = next(n for n, _, _, _ in reversed(stack) if n in _BLOCK or not n)
                    if above == "p":
                        close("p")
                while stack[-1][0] in _ENDS.get(name, ()):
                    close(stack[-1][0])
            counts = stack[-1][2] and not without and not (header and not stack[-1][3])
            if block or not counts:
                # Other elements are no part of the page's structure.
                parent = stack[-1][1]
                token = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), self.elements[parent]) >> 2 << 1
                self.elements.append(token)
                self.parents.append(parent)
                self.roles.append(role if counts else INNER)
                self.depths.append(self.depths[parent] + 1)
                self.chars.append(0)
                self.tokens.append(token)
                stack.append((name, len(self.elements) - 1, counts, stack[-1][3] or role > PLAIN))
                names[name] += 1
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
        end_block()

    def own_template(self) -> list[set[int]]:
        """The main elements of a page that is alone."""
        often = Counter(self.elements)
        found = [
            (e, INNER if role == PLAIN and often[e] > 1 else role, depth, chars)
            for e, role, depth, chars in zip(self.elements, self.roles, self.depths, self.chars, strict=True)
        ]
        return main_elements(found, self.chars[0])

    def main_text(self, mains: list[set[int]], texts: set[int]) -> str:
        """The blocks below the first main elements that the page has, without the template's own ``texts``."""
        own = set(self.elements)
        main = next((m for m in mains if m & own), None)
        if main is None:
            main, texts = next((m for m in self.own_template() if m & own), set()), set()
        inside = [False] * len(self.elements)
        for i, element in enumerate(self.elements):
            inside[i] = inside[self.parents[i]] or element in main
        blocks = [(text, token) for text, token, at in self.blocks if inside[at]]
        slots = [text for text, token in blocks if token not in texts]
        return "\n".join(slots or [text for text, _ in blocks])


def main_elements(found: list[tuple[int, int, int, int]], total: int) -> list[set[int]]:
    """Which elements hold the main text, first choice first, from token, role, depth and characters of all elements.

    An element that a page has several times is a part of its content, unless it is named an article.
    """
    sums: dict[int, int] = Counter()
    for element, _, _, chars in found:
        sums[element] += chars
    roles = [{e for e, role, _, _ in found if role == wanted} for wanted in (ARTICLE, MAIN)]
    dense = max(((d, e) for e, role, d, _ in found if role >= PLAIN and sums[e] >= MAIN_SHARE * total), default=(0, 0))
    return [*[r for r in roles if r], {dense[1]}]


_OUTLINE = "host string, page bigint, tokens array<bigint>, known array<struct<token:bigint,depth:int,role:int,chars:bigint>>"
_COUNT = "host string, token bigint, support bigint, occurrences bigint, vector bigint, place bigint, chars bigint, depth int, role int"
_CLASSES = "host string, pages bigint, chars bigint, tokens array<struct<token:bigint,class:int,place:int,support:bigint,chars:bigint,depth:int,role:int>>"
_VERDICT = "host string, class int, parent bigint, pages bigint"
_TEMPLATE = "host string, mains array<array<bigint>>, texts array<bigint>"
_BROKEN, _TOP = -2, -1
# A slot is a class and the place of the token before it.
_PLACES = 1 << 20


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = pa.struct([("token", pa.int64()), ("depth", pa.int32()), ("role", pa.int32()), ("chars", pa.int64())])
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("tokens", pa.list_(pa.int64())), ("known", pa.list_(known))])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                page = Page(source)
                seen: dict[int, list[int]] = {}
                # Where the text lies by its share is learnt from the pages that do not name the place.
                named = max(page.roles) > PLAIN
                for i, element in enumerate(page.elements):
                    row = seen.setdefault(element, [page.depths[i], page.roles[i], 0])
                    row[2] += page.chars[i] if not named or page.roles[i] > PLAIN else 0
                for text, token, at in page.blocks:
                    seen.setdefault(token, [page.depths[at], PLAIN, 0])[2] += len(text)
                yield {
                    "host": host,
                    # Equal pages get the same number, which changes no vector's equality.
                    "page": xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass")) >> 3,
                    "tokens": page.tokens,
                    "known": [{"token": t, "depth": d, "role": r, "chars": c} for t, (d, r, c) in seen.items()],
                }

    yield from batches_of(rows(), schema, 500)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums per host and token; token 0 counts the pages and the text of those that name no main element."""
    schema = pa.schema([("host", pa.string())] + [(f.split()[0], pa.int32() if f.endswith("int") and not f.endswith("bigint") else pa.int64()) for f in _COUNT.split(", ")[1:]])
    sums: dict[tuple[str, int], list[int]] = {}

    def rows() -> Iterator[dict]:
        names = schema.names[2:]
        for (host, token), values in sums.items():
            yield {"host": host, "token": token, **dict(zip(names, values, strict=True))}
        sums.clear()

    for batch in batches:
        for row in batch.to_pylist():
            host, number = row["host"], row["page"]
            known = {k["token"]: k for k in row["known"]}
            first: dict[int, int] = {}
            for place, token in enumerate(row["tokens"]):
                first.setdefault(token, place)
            for token, n in [*Counter(row["tokens"]).items(), (0, 1)]:
                k = known.get(token) or {"depth": 0, "role": PLAIN, "chars": 0}
                values = sums.get((host, token))
                if values is None:
                    values = sums[host, token] = [0, 0, 0, 0, 0, k["depth"], k["role"]]
                values[0] += 1
                values[1] += n
                values[2] = (values[2] + n * number) % _PRIME
                values[3] += first.get(token, 0)
                values[4] += k["chars"]
            if len(sums) > _COUNTED:
                yield from batches_of(rows(), schema)
    yield from batches_of(rows(), schema)


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host the classes of tokens with equal vectors, tokens in the order of their mean first place."""
    token = pa.struct([("token", pa.int64()), ("class", pa.int32()), ("place", pa.int32()), ("support", pa.int64()),
                       ("chars", pa.int64()), ("depth", pa.int32()), ("role", pa.int32())])
    schema = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("chars", pa.int64()), ("tokens", pa.list_(token))])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                classes = defaultdict(list)
                for t in row["counts"]:
                    classes[t["support"], t["occurrences"], t["vector"]].append(t)
                tokens = []
                # A single token bounds no slot.
                for number, (_, members) in enumerate(sorted(c for c in classes.items() if len(c[1]) > 1)):
                    members.sort(key=lambda t: (t["place"], t["token"]))
                    tokens += [
                        {
                            "token": t["token"], "class": number, "place": i,
                            "role": INNER if t["role"] == PLAIN and t["occurrences"] > t["support"] else t["role"],
                            **{k: t[k] for k in ("support", "chars", "depth")},
                        }
                        for i, t in enumerate(members)
                    ]
                yield {"host": row["host"], "pages": row["pages"], "chars": row["chars"], "tokens": tokens}

    yield from batches_of(rows(), schema, 50)


def slots_of(tokens: list[int], places: dict[int, tuple[int, int]], sizes: dict[int, int]) -> dict[int, int]:
    """Per class that a page has: the slot that all its occurrences lie in, or ``_BROKEN``."""
    found: dict[int, int] = {}
    reached: dict[int, int] = {}
    is_open: list[int] = []
    for token in tokens:
        spot = places.get(token)
        if spot is None:
            continue
        number, place = spot
        if place != reached.get(number, 0):
            found[number] = _BROKEN
            continue
        if place == 0:
            slot = is_open[-1] * _PLACES + reached[is_open[-1]] if is_open else _TOP
            if found.setdefault(number, slot) != slot:
                found[number] = _BROKEN
            is_open.append(number)
        elif is_open[-1] != number:
            # What was opened in this slot has not ended in it.
            while is_open[-1] != number:
                reached.pop(is_open[-1])
                found[is_open.pop()] = _BROKEN
        reached[number] = place + 1
        if place + 1 == sizes[number]:
            is_open.pop()
            reached[number] = 0
    for number in is_open:
        found[number] = _BROKEN
    return found


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, class and slot the pages on which the class lies there in order."""
    schema = pa.schema([("host", pa.string()), ("class", pa.int32()), ("parent", pa.int64()), ("pages", pa.int64())])
    pages: Counter = Counter()
    table_of = {}

    def rows() -> Iterator[dict]:
        for (host, number, slot), n in pages.items():
            yield {"host": host, "class": number, "parent": slot, "pages": n}
        pages.clear()

    for batch in batches:
        hosts = batch["host"].to_pylist()
        for i, tokens in enumerate(batch["tokens"].to_pylist()):
            if hosts[i] not in table_of:
                if len(table_of) > 100:
                    table_of.clear()
                table = batch["classes"][i].as_py()
                places = {t["token"]: (t["class"], t["place"]) for t in table}
                table_of[hosts[i]] = places, Counter(number for number, _ in places.values())
            for number, slot in slots_of(tokens, *table_of[hosts[i]]).items():
                pages[hosts[i], number, slot] += 1
        if len(pages) > _COUNTED:
            yield from batches_of(rows(), schema)
    yield from batches_of(rows(), schema)


def nested_classes(verdicts: list[dict]) -> set[int]:
    """Classes that are in order and in one slot, and whose classes around them are."""
    slots = defaultdict(Counter)
    for v in verdicts:
        slots[v["class"]][v["parent"]] += v["pages"]
    parent = {}
    for number, found in slots.items():
        slot, pages = max(found.items(), key=lambda x: (x[1], x[0]))
        if slot != _BROKEN and pages >= (1 - TOLERANCE) * found.total():
            parent[number] = slot if slot == _TOP else slot // _PLACES
    valid: set[int] = set()
    for number in parent:
        path = []
        while number != _TOP and number in parent and number not in valid and number not in path:
            path.append(number)
            number = parent[number]
        if number == _TOP or number in valid:
            valid.update(path)
    return valid


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("mains", pa.list_(pa.list_(pa.int64()))), ("texts", pa.list_(pa.int64()))])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                valid = nested_classes(row["verdicts"] or [])
                tokens = [t for t in row["tokens"] if t["class"] in valid]
                # An element of the template starts and ends in one class.
                where = {t["token"]: t["class"] for t in tokens}
                elements = [t for t in tokens if not t["token"] & 1 and where.get(t["token"] ^ 0x5A5A5A5A) == t["class"]]
                found = [(t["token"], t["role"], t["depth"], t["chars"]) for t in elements if t["chars"]]
                mains = main_elements(found, row["chars"])
                texts = [t for t in tokens if t["token"] & 1 and t["support"] == row["pages"] >= TEXT_PAGES]
                held = row["chars"] + sum(chars for _, role, _, chars in found if role > PLAIN)
                if sum(t["chars"] for t in texts) > TEXT_SHARE * held:
                    texts = []
                yield {"host": row["host"], "mains": [sorted(m) for m in mains if m != {0}], "texts": sorted(t["token"] for t in texts)}

    yield from batches_of(rows(), schema, 50)


def deduce_templates(pages: DataFrame) -> DataFrame:
    """Per host of ``pages`` (host, html) with a template its main elements, first choice first, and its own texts."""
    outlines = stored(pages.select("host", "html").where("host <> ''").mapInArrow(_outlines, _OUTLINE), "outlines")
    counts = outlines.mapInArrow(_counted, _COUNT).groupBy("host", "token").agg(
        F.sum("support").alias("support"),
        F.sum("occurrences").alias("occurrences"),
        # Sums of numbers below the prime need more than 63 bits.
        (F.sum(F.col("vector").cast("decimal(38,0)")) % F.lit(_PRIME).cast("decimal(38,0)")).cast("bigint").alias("vector"),
        (F.sum("place") / F.sum("support")).alias("place"),
        F.sum("chars").alias("chars"),
        F.min("depth").alias("depth"),
        F.max("role").alias("role"),
    )
    counts = stored(counts.where(F.col("support") >= PAGES), "counts")
    totals = counts.where("token = 0").select("host", F.col("support").alias("pages"), F.col("chars").alias("host_chars"))
    is_text = F.col("token").bitwiseAND(F.lit(1).cast("bigint")) == 1
    enough = F.when(is_text, (F.col("support") == F.col("pages")) & (F.col("pages") >= TEXT_PAGES)).otherwise(
        F.col("support") >= F.col("pages") * SUPPORT
    )
    fields = ("token", "support", "occurrences", "vector", "place", "chars", "depth", "role")
    tables = (
        counts.where("token <> 0").join(totals, "host").where(enough)
        .groupBy("host", "pages", "host_chars").agg(F.collect_list(F.struct(*fields)).alias("counts"))
        .withColumnRenamed("host_chars", "chars")
        .mapInArrow(_classified, _CLASSES)
    )
    tables = stored(tables, "classes")
    verdicts = (
        outlines.select("host", "tokens")
        .join(tables.select("host", F.col("tokens").alias("classes")), "host")
        .mapInArrow(_judged, _VERDICT)
        .groupBy("host", "class", "parent").agg(F.sum("pages").alias("pages"))
        .groupBy("host").agg(F.collect_list(F.struct("class", "parent", "pages")).alias("verdicts"))
    )
    return stored(tables.join(verdicts, "host", "left").mapInArrow(_deduced, _TEMPLATE), "templates")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                mains = [set(m) for m in row["mains"] or []]
                text = Page(row["html"]).main_text(mains, set(row["texts"] or []))
                yield {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

    yield from batches_of(rows(), schema, 500)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` per row of ``pages`` (page_id, url, html)."""
    authority = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url",
        F.coalesce("html", F.lit("")).alias("html"), F.coalesce(F.lower(authority), F.lit("")).alias("host"),
    )
    return pages.join(deduce_templates(pages), "host", "left").drop("host").mapInArrow(
        _extracted, "page_id bigint, url string, text string, n_chars bigint"
    )


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))
