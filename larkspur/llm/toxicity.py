"""Operator 9: toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words sums, over the three-letter subsequences they share, the products of the subsequences'
weights; a weight falls by ``DECAY`` with each place spanned, up to ``SPAN`` places, so a word with skipped or
inserted letters stays close to the plain one. A second kernel takes the landmark as one subsequence: different letters put
between its own, up to one per gap, letters after them and letters before them cost more and more. Words lose
everything but letters first, and are read once more with usual digits and marks as the letters they stand for; single
letters set apart by blanks or marks are read as one word as well. A document is compared with a landmark by its closest
word in each kernel.

Landmarks are words of the training rows that mark toxic ones, or the beginnings that such words share, marked by a star, after which
any letters may follow; none is close to another. Values of the first kernel against the landmarks, times the inverse root of the
landmarks' own kernel matrix, and those of the second are the features of a linear support vector machine; a logistic curve
over its margin gives the score. Toxic rows hold several landmarks, so the machine also learns from each landmark
alone, weighted by the rows of both classes that hold it, and from virtual examples of what a landmark should and should not forgive: a letter put
in changes nothing, a letter put before a word makes another word.

Null and empty texts have no word and get the score of a text far from all landmarks. Words of any length count,
long ones in overlapping cuts. Repeated rows get equal scores each. Without training rows of both classes the score is 0.
An empty table gives no rows. Extra columns are not read, or travel inside a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import ROW, read_table, small_batches, texts_of, tidy, whole_row
from larkspur.session import materialise

# Training rows of each class at most; the machine is fitted on this bounded sample, all else covers all rows.
TRAINING_ROWS = 6_000
LANDMARKS = 96
# Distinct toxic training texts that hold a landmark, at least, and their share of all such texts.
LEAST_ROWS = 3
LEAST_RATE = 0.02
DECAY = 0.7
SPAN = 6
# Values of the first kernel up to this count as 0; unrelated words reach it by chance. The second has no floor.
FLOOR = 0.3
# What another letter between the landmark's own, one after and one before them leaves of the second kernel's value. A
# letter that is put in again and again counts once: those who hide a word repeat it, unlike words that hold it by chance.
GAP, AFTER, BEFORE = 0.88, 0.8, 0.4
# Lengths of beginnings that may be landmarks, and the mark of one.
_STEMS = range(4, 9)
STEM = "*"
# Letters that make another word of one, in the virtual examples.
_BEFORE, _AFTER = ("b", "t", "x", "un", "re"), ("ing", "ed", "age")
# Digits and marks that stand for letters.
_STANDS_FOR = str.maketrans("013457@$", "oieastas")
_FIGURES = re.compile(r"[^\W\d_][^\s]*[013457@$]|[013457@$][^\s]*[^\W\d_]")
# Words below this in the first kernel are not looked at in the second.
NEAR = 0.05
FOLDS = 5
CACHED_WORDS = 200_000
# Words that are compared with the landmarks together.
_TOGETHER = 5_000
_CUT = 24
_CLASSES = 64
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[^\w\n]{1,3}|_)(?:[^\W\d_](?:[^\w\n]{1,3}|_))+[^\W\d_](?![^\W\d_])")
_LETTERS = re.compile(r"[\W\d_]+")


def spaced_words(text: str) -> list[str]:
    """Runs of single letters set apart by blanks or marks."""
    return _SPACED.findall(text)


def units(word: str) -> list[str]:
    """A word's letters in lower case, as they are and with figures read as letters, cut into overlapping parts if there are
    many; none for under three."""
    word = word.lower()
    readings = [word, word.translate(_STANDS_FOR)] if _FIGURES.search(word) else [word]
    found = []
    for letters in dict.fromkeys(_LETTERS.sub("", r) for r in readings):
        if len(letters) > _CUT:
            found += [letters[i : i + _CUT] for i in range(0, len(letters) - _CUT // 2, _CUT // 2)]
        elif len(letters) >= 3:
            found.append(letters)
    return found


def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of three letters within ``SPAN``, and their weights."""
    found = [
        (i, j, k) for i in range(size) for j in range(i + 1, size) for k in range(j + 1, min(size, i + SPAN))
    ]
    places = np.array(found).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1.0)


_PLACES = {n: _places(n) for n in range(3, _CUT + 1)}


def _subsequences(words: list[str], size: int) -> np.ndarray:
    """Codes of the subsequences of words of one length. Letters fall into 64 classes, a to z apart."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, size).astype(np.int64)
    letters = np.where((points >= 97) & (points < 123), points - 97, 26 + points % (_CLASSES - 26))
    places = _PLACES[size][0]
    return (letters[:, places[:, 0]] * _CLASSES + letters[:, places[:, 1]]) * _CLASSES + letters[:, places[:, 2]]


def whole_value(landmark: str, word: str) -> float:
    """The landmark as one subsequence of the word, by its best place; 0 if that is over a letter per gap."""
    stem = landmark.endswith(STEM)
    landmark = landmark.removesuffix(STEM)
    size, best = len(landmark), 0.0
    start = word.find(landmark[0])
    while 0 <= start <= len(word) - size and not (stem and start):
        at, between = start, ""
        for letter in landmark[1:]:
            here = word.find(letter, at + 1, start + 2 * size - 1)
            if here < 0:
                break
            between += word[at + 1 : here]
            at = here
        else:
            after = 1.0 if stem else AFTER ** (len(word) - at - 1)
            # A beginning is met by chance sooner than a word.
            gaps = len(set(between)) * (2 if stem else 1)
            best = max(best, GAP**gaps * after * BEFORE**start)
        start = word.find(landmark[0], start + 1)
    return best


@dataclass
class Kernel:
    """Kernel values of words against landmarks."""

    landmarks: list[str]
    columns: np.ndarray = field(init=False, repr=False)
    weights: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        plain = [z.removesuffix(STEM) for z in self.landmarks]
        codes = [_subsequences([z], len(z))[0] for z in plain]
        known = np.unique(np.concatenate([np.empty(0, np.int64), *codes]))
        self.columns = np.full(_CLASSES**3, -1, dtype=np.int32)
        self.columns[known] = np.arange(len(known))
        self.weights = np.zeros((len(known), len(self.landmarks)))
        for j, (z, own) in enumerate(zip(plain, codes, strict=True)):
            weight = _PLACES[len(z)][1]
            np.add.at(self.weights[:, j], self.columns[own], weight / np.sqrt((weight**2).sum()))

    def values(self, words: list[str]) -> np.ndarray:
        """One row per word, each of 3 to ``_CUT`` letters; 1 is as close as a word is to itself."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        for size, members in by_size.items():
            weight = _PLACES[size][1]
            weight = weight / np.sqrt((weight**2).sum())
            for start in range(0, len(members), 2_000):
                part = members[start : start + 2_000]
                column = self.columns[_subsequences([words[i] for i in part], size)]
                row, place = np.nonzero(column >= 0)
                cells = row * len(self.weights) + column[row, place]
                held = np.bincount(cells, weight[place], len(part) * len(self.weights))
                out[part] = held.reshape(len(part), -1) @ self.weights
        return np.minimum(out, 1.0)

    def both(self, words: list[str]) -> np.ndarray:
        """The values above the floor, at least those of whole landmarks, and the latter beside them."""
        values = self.values(words)
        whole = np.zeros_like(values)
        for i, j in np.argwhere(values >= NEAR).tolist():
            whole[i, j] = whole_value(self.landmarks[j], words[i])
        return np.concatenate([np.maximum(np.maximum(values, whole) - FLOOR, 0), whole], axis=1)


class Scanner:
    """For each text the values of its closest words in both kernels; each distinct word is looked at once."""

    def __init__(self, landmarks: list[str]) -> None:
        self.kernel = Kernel(landmarks)
        self.seen: set[str] = set()
        self.close: dict[str, np.ndarray] = {}

    def _learn(self, words: set[str]) -> None:
        pairs = [(w, u) for w in words for u in units(w)]
        if pairs:
            distinct = list(dict.fromkeys(u for _, u in pairs))
            near: dict[str, np.ndarray] = {}
            for start in range(0, len(distinct), _TOGETHER):
                part = distinct[start : start + _TOGETHER]
                values = self.kernel.both(part)
                near.update((part[i], values[i].copy()) for i in np.flatnonzero(values.any(axis=1)))
            for word, unit in pairs:
                if unit in near:
                    self.close[word] = np.maximum(self.close.get(word, 0), near[unit])
        self.seen |= words

    def features(self, texts: list[str]) -> np.ndarray:
        if len(self.seen) > CACHED_WORDS:
            self.seen, self.close = set(), {}
        split = [{*t.split(), *spaced_words(t)} for t in texts]
        self._learn(set().union(*split) - self.seen)
        out = np.zeros((len(texts), 2 * len(self.kernel.landmarks)), dtype=np.float32)
        for i, words in enumerate(split):
            for word in words & self.close.keys():
                np.maximum(out[i], self.close[word], out=out[i])
        return out


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from all learning."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(False))


def _landmark_features(df: DataFrame, landmarks: list[str], text_column: str, by: np.ndarray) -> DataFrame:
    """Each row as struct ``row`` with its values against the landmarks times the matrix ``by``."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(landmarks)
        for batch in batches:
            texts = texts_of(batch, text_column)
            parts = [
                scanner.features([t.decode() for t in texts.slice(start, 500).to_pylist()])
                for start in range(0, len(texts), 500)
            ]
            values = np.concatenate([np.empty((0, len(by))), *parts]) @ by
            offsets = np.arange(len(values) + 1, dtype=np.int32) * by.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch[ROW], lists], [ROW, "values"])

    rows = small_batches(df).select(whole_row(df))
    out = T.StructType([rows.schema[ROW], T.StructField("values", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(tidy(scanned), out)


def _training_rows(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold, as many of each class at most."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()

    def of(label: int) -> DataFrame:
        return known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    # A few thousand ids and labels, bounded by ``rows``.
    return texts.join(F.broadcast(of(0).unionByName(of(1))), "doc_id").select("text", "toxic")


def _beginnings(size: int) -> Column:
    longer = F.filter("words", lambda w: F.length(w) > size)
    return F.transform(longer, lambda w: F.concat(F.left(w, F.lit(size)), F.lit(STEM)))


def choose_landmarks(training: DataFrame, count: int = LANDMARKS) -> list[tuple[str, int, int]]:
    """Words and beginnings of words that tell toxic from other rows best, each unlike those before it.

    With each come the toxic and the other texts that hold it.
    """
    # Copies of a text count once; the rest is counted by text, wherever the word stands in it.
    texts = training.select("text", "toxic").distinct()
    words = texts.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("words"))
    words = words.withColumn("words", F.filter("words", lambda w: F.length(w).between(3, _CUT)))
    terms = words.select("toxic", F.explode(F.array_distinct(F.concat("words", *map(_beginnings, _STEMS)))).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = texts.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    all_bad, all_good = totals["bad"] or 0, totals["good"] or 0
    if not all_bad or not all_good:
        return []
    # Not rare in toxic texts and twenty times rarer elsewhere; terms that a few texts share by chance are left out.
    bad_rate, good_rate = F.col("bad") / all_bad, (F.col("good") + 0.5) / all_good
    telling = (F.col("bad") >= LEAST_ROWS) & (bad_rate >= LEAST_RATE) & (bad_rate >= 20 * good_rate)
    gain = F.col("bad") * F.log2(bad_rate / good_rate)
    # The driver gets a bounded list; of terms that tell as much, words and then longer beginnings come first.
    ranked = counted.where(telling).orderBy(F.desc(gain), F.col("term").endswith(STEM), F.desc(F.length("term")), "term")
    chosen: list[tuple[str, int, int]] = []
    for row in ranked.limit(40 * count).collect():
        term, known = row["term"], [c[0] for c in chosen]
        plain = term.removesuffix(STEM)
        whole = [max(whole_value(z, plain), whole_value(term, z.removesuffix(STEM))) for z in known]
        if not chosen or max(Kernel(known).values([plain]).max(), *whole) < 0.8:
            chosen.append((term, row["bad"], row["good"]))
            if len(chosen) == count:
                break
    return chosen


def lessons(landmarks: list[tuple[str, int, int]]) -> list[tuple[str, float, float]]:
    """Texts of one word each, with label and weight: every landmark alone, with one or two letters put in, and within another word."""
    found = []
    for term, bad, good in landmarks:
        word = term.removesuffix(STEM)
        forms = [word]
        if not term.endswith(STEM):
            forms += [word[:i] + "x" + word[i:] for i in range(1, len(word))]
            forms += [word[:i] + "q" + word[i : i + 2] + "x" + word[i + 2 :] for i in range(1, len(word) - 2)]
        found += [(form, 1.0, bad / len(forms)) for form in forms]
        found += [(word, 0.0, float(good))] if good else []
        others = [letters + word for letters in _BEFORE]
        others += [] if term.endswith(STEM) else [word + letters for letters in _AFTER]
        found += [(form, 0.0, bad / len(others)) for form in others]
    return found


@dataclass
class ToxicityModel:
    """Landmarks, a weight for each in both kernels, and the logistic curve; ``weights`` take in the Nyström map."""

    landmarks: list[str]
    weights: list[float]
    intercept: float


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, landmarks: int = LANDMARKS
) -> ToxicityModel | None:
    """The model of the labelled rows outside the held-out fold; None if one class is missing there."""
    training = materialise(_training_rows(documents, labels, rows), "toxicity_rows")
    counted = choose_landmarks(training, landmarks)
    if not counted:
        return None
    chosen = [term for term, _, _ in counted]
    own = Kernel(chosen).values([z.removesuffix(STEM) for z in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(chosen)))
    root = np.eye(2 * len(chosen))
    root[: len(chosen), : len(chosen)] = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    plain = _landmark_features(training, chosen, "text", root)
    features = materialise(plain.select(f"{ROW}.toxic", F.col("values").alias("mapped")), "toxicity_features")
    counts = {r["toxic"]: r["count"] for r in features.groupBy("toxic").count().collect()}
    # Nearer to equal weight for rows than for classes.
    balance = (counts[0] / counts[1]) ** 0.2
    weight = F.when(F.col("toxic") == 1, balance).otherwise(1.0)
    rows_ = features.select("mapped", F.col("toxic").cast("double").alias("label"), weight.alias("w"))
    taught = lessons(counted)
    alone = Scanner(chosen).features([text for text, _, _ in taught]) @ root
    single = documents.sparkSession.createDataFrame(
        [(values.tolist(), label, w * balance) for values, (_, label, w) in zip(alone, taught, strict=True)],
        "mapped array<double>, label double, w double",
    )
    vectors_ = rows_.unionByName(single).select(array_to_vector("mapped").alias("features"), "label", "w").coalesce(2).cache()
    machine = LinearSVC(maxIter=60, regParam=1e-4, weightCol="w", standardization=False).fit(vectors_)
    margins = machine.transform(vectors_).select(
        F.slice(vector_to_array("rawPrediction"), 2, 1).alias("m"), "label", "w"
    ).select(array_to_vector("m").alias("features"), "label", "w")
    curve = LogisticRegression(maxIter=20, regParam=1e-3, weightCol="w").fit(margins)
    vectors_.unpersist()
    slope = float(curve.coefficients[0])
    weights = root @ np.array(machine.coefficients.toArray()) * slope
    return ToxicityModel(chosen, weights.tolist(), float(machine.intercept) * slope + float(curve.intercept))


def score_toxicity(df: DataFrame, model: ToxicityModel | None, text_column: str = "text") -> DataFrame:
    """Each row of ``df`` as struct ``row`` with its ``score`` from 0 to 1."""
    if model is None:
        return df.select(whole_row(df), F.lit(0.0).alias("score"))
    margins = _landmark_features(df, model.landmarks, text_column, np.array(model.weights)[:, None])
    return margins.select(ROW, (1 / (1 + F.exp(-(F.col("values")[0] + model.intercept)))).alias("score"))


def drop_toxic(df: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows of ``df`` that score below 0.5, with the columns of ``df``."""
    kept = score_toxicity(df, model).where("score < 0.5")
    return kept.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in df.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        f"{ROW}.doc_id",
        held_out(f"{ROW}.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
