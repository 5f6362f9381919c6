"""Operator 1: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import cut, fresh, join_small, sliced, table

#: Labelled training rows that a model is fitted on, about; chosen by a hash of the id.
SAMPLE = 20_000
#: Terms of the lexicon, a size of the model: those of the highest log-odds in the bounded sample.
LEXICON = 8_000
#: Folds of the training rows: a row's lexicon features come from the other folds' counts, and
#: fold 0 calibrates what the others have trained.
FOLDS = 4
#: Log-odds from which a lexicon term counts as mild, strong and very strong.
STEPS = (1.0, 2.0, 3.0)
#: Letters that open a term of the prefix lexicon, and the words within which "you" is near.
PREFIX, NEAR = 4, 5
MEMO = 60_000

#: Second-person words of the languages served; fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split()
)
#: Signs that stand for letters in disguised words; fixed values.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
ODD = re.compile(r"[^\W\d_][\d@$!*._-]+[^\W\d_]")
REPEATED = re.compile(r"(.)\1\1")

NAMES = (
    "mild", "strong", "very_strong", "count_strong", "prefix_mild", "prefix_strong", "prefix_very_strong",
    "count_prefix", "second_person", "near_second_person", "capitals", "shouted", "exclaims", "asks", "punctuation",
    "digits", "obfuscated",
)


def plain_word(raw: str) -> str:
    return EDGE.sub("", raw).lower()


def revealed(word: str) -> str:
    """A disguised word with its letters put back."""
    return word if word.isalpha() else word.translate(DISGUISE)


def terms(text: str) -> set[str]:
    """The lexicon terms of a text: its words, and the beginnings of longer words."""
    words = {revealed(plain_word(w)) for w in set(text.split())}
    return {w for w in words if w} | {f"{w[:PREFIX]}*" for w in words if len(w) > PREFIX}


class WordCodes(dict):
    """Per raw word a byte: lexicon step (2 bits), prefix step (2), second person, shouted, obfuscated."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        if len(self) > MEMO:
            self.clear()
        edge = EDGE.sub("", raw)
        low = edge.lower()
        word = revealed(low)
        code = self.lexicon.get(word, 0)
        if len(word) > PREFIX:
            code |= self.lexicon.get(f"{word[:PREFIX]}*", 0) << 2
        if low in SECOND_PERSON:
            code |= 16
        if len(edge) > 2 and edge.isupper():
            code |= 32
        if ODD.search(edge) or REPEATED.search(low):
            code |= 64
        self[raw] = code
        return code


#: Kinds of characters: 0 other, 1 small letter, 2 capital, 3 digit, 4 "!", 5 "?", 6 other ASCII punctuation.
_KIND = np.array([1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0 for c in map(chr, range(1 << 16))], np.uint8)
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 6
_KIND[[33, 63, 0xFFFF]] = 4, 5, 0


def features(text: str | None, codes: WordCodes) -> list[float]:
    """The values of ``NAMES`` for a text; all 0 for an empty one. Words are those of ``terms``."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    code = np.fromiter(map(codes.__getitem__, words), np.uint8, n)
    got = np.bincount(code, minlength=128).reshape(8, 4, 4)  # flags, prefix step, word step
    step, prefix = got.sum(axis=(0, 1)), got.sum(axis=(0, 2))
    flag = got.sum(axis=(1, 2))
    second, shouted, odd = flag[1::2].sum(), flag[[2, 3, 6, 7]].sum(), flag[4:].sum()
    near = 0
    if second and step[2] + step[3] + prefix[2] + prefix[3]:
        bad = np.flatnonzero(((code & 3) >= 2) | (((code >> 2) & 3) >= 2))
        you = np.flatnonzero(code & 16)
        at = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(bad - you[np.minimum(at, len(you) - 1)]), np.abs(bad - you[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    places = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KIND[np.minimum(places, 0xFFFF)], minlength=7)
    letters, size = max(1, int(kinds[1] + kinds[2])), len(places)
    return [
        step[1] / n, step[2] / n, step[3] / n, math.log1p(step[2] + step[3]), prefix[1] / n, prefix[2] / n, prefix[3] / n,
        math.log1p(prefix[2] + prefix[3]), second / n, math.log1p(near), kinds[2] / letters, shouted / n, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        kinds[3] / size, odd / n,
    ]


def with_features(docs: DataFrame, text_col: str, lexica: dict[int, dict[str, int]], name: str, fold_col: str | None = None) -> DataFrame:
    """``docs`` with a column ``name`` of features; the lexicon is that of the row's fold, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {f: WordCodes(lexicon) for f, lexicon in lexica.items()}
        for batch in sliced(batches):
            folds = batch.column(fold_col).to_pylist() if fold_col else [-1] * batch.num_rows
            texts = batch.column(text_col)
            got = [features(texts[i].as_py(), codes[f]) for i, f in enumerate(folds)]
            flat = pa.array(np.array(got, np.float64).ravel())
            offsets = pa.array(np.arange(len(got) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.array(F.lit(0.0))).schema)


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, fold, toxic, n`` from ``text, fold, toxic``: in how many texts a term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            columns = (batch.column(c) for c in ("text", "fold", "toxic"))
            for text, fold, toxic in zip(*columns, strict=True):
                f, t = fold.as_py(), toxic.as_py()
                seen.update([(term, f, t) for term in terms(text.as_py() or "")])
            keys = list(seen)
            arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "fold", "toxic", "n"])

    return rows.mapInArrow(run, "term string, fold int, toxic int, n long").groupBy("term", "fold", "toxic").agg(F.sum("n").alias("n"))


def build_lexica(rows: DataFrame, size: int = LEXICON) -> dict[int, dict[str, int]]:
    """Lexicon steps per fold, each from the other folds, and under -1 from all."""
    totals = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    cells = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)]
    sums = [F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"all{t}") for t in (0, 1)]
    all_n = [sum(n for (_, t), n in totals.items() if t == want) for want in (0, 1)]
    odds = F.log(((F.col("all1") + 0.5) / (all_n[1] + 1)) / ((F.col("all0") + 0.5) / (all_n[0] + 1)))
    found = term_counts(rows).groupBy("term").agg(*sums, *cells).where("all1 >= 2").withColumn("odds", odds).where(F.col("odds") >= STEPS[0])
    kept = found.orderBy(F.col("odds").desc(), F.col("all1").desc(), "term").limit(size).collect()
    lexica: dict[int, dict[str, int]] = {}
    for fold in (-1, *range(FOLDS)):
        n = [sum(c for (f, t), c in totals.items() if t == want and f != fold) for want in (0, 1)]
        own: dict[str, int] = {}
        for r in kept:
            c = [r[f"all{t}"] - (r[f"n{fold}_{t}"] if fold >= 0 else 0) for t in (0, 1)]
            if c[1] >= 2:
                weight = math.log(((c[1] + 0.5) / (n[1] + 1)) / ((c[0] + 0.5) / (n[0] + 1)))
                step = sum(weight >= s for s in STEPS)
                if step:
                    own[r["term"]] = step
        lexica[fold] = own
    return lexica


@dataclass
class ToxicityModel:
    """A fitted scorer. ``trees`` is None if the labels were of one kind; then ``prior`` is the score."""

    lexicon: dict[str, int]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with the calibrated score in column ``name``."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.prior))
        own = [fresh(docs, x) for x in ("features", "raw", "margin", "level")]
        rows = with_features(docs, text_col, {-1: self.lexicon}, own[0]).withColumn(own[0], array_to_vector(own[0]))
        rows = self.trees.copy({self.trees.featuresCol: own[0], self.trees.rawPredictionCol: own[1], self.trees.probabilityCol: "", self.trees.predictionCol: ""}).transform(rows)
        rows = rows.withColumn(own[2], vector_to_array(own[1])[1])
        rows = self.calibration.copy({self.calibration.featuresCol: own[2], self.calibration.predictionCol: own[3]}).transform(rows)
        return rows.withColumn(name, _blend(F.col(own[3]), F.col(own[2]))).drop(*own)


def _blend(level: Column, margin: Column) -> Column:
    """The isotonic level, with a hundredth of the margin's own order inside a level."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), level * 0.99 + 0.01 / (F.lit(1.0) + F.exp(-2.0 * margin))))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on about ``sample`` labelled rows that are not held out.

    The sample and the order of its rows are the same for any layout. Unlabelled rows and null labels or
    ids take no part; equal rows of one id count once.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1_000_000)) < round(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int")
    rows = cut(join_small(texts, picked, "doc_id").dropDuplicates(["doc_id", "text"]).withColumn("fold", fold))
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(kinds.values())
    prior = kinds.get(1, 0) / total if total else 0.0
    fitted = rows.where("fold > 0").select("toxic").distinct().count()
    if fitted < 2 or rows.where("fold = 0").isEmpty():
        return ToxicityModel({}, None, None, prior)
    lexica = build_lexica(rows)
    made = with_features(rows, "text", lexica, "features", "fold")
    # splits are sampled by a row's place, so places depend on the rows alone
    order = ["doc_id", "text_hash"]
    made = made.withColumn("text_hash", F.xxhash64("text")).repartition(6, *order).sortWithinPartitions(*order)
    made = cut(made.select("fold", F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("features")))
    trees = GBTClassifier(maxIter=20, maxDepth=4, minInstancesPerNode=5, maxBins=48, stepSize=0.2, seed=7, maxMemoryInMB=64).fit(made.where("fold > 0"))
    held = trees.transform(made.where("fold = 0")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held)
    return ToxicityModel(lexica[-1], trees, calibration, prior)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Features are densities of lexicon words and word beginnings learned from the training rows,
    their nearness to second-person words, and rates of capitals, punctuation and disguised
    words; ids, languages and sources are never features. Labels of held-out rows are not read. Null texts
    score as empty ones, texts of any length whole, equal texts alike. Repeated rows and ids
    have a row each; a null id is not held out; an id labelled twice is toxic if one label says so. Columns of
    any name beside play no part; an empty table gives no rows. Without training rows of both kinds
    every score is the share of toxic ones.
    """
    model = train_toxicity(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = model.score(rows)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
