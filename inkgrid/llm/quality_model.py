"""Quality classifier by compression.

Two zstandard dictionaries are built from texts labelled good and bad.  A text is compressed in blocks with either one.  The
normalised difference of two sizes x and y is (x - y) / (x + y); it is taken of the sizes with the bad and with the good
dictionary, and of the plain and the good one, each over the whole text and in its worst block.  These differences alone are
calibrated to a probability by a logistic fit on labelled texts that were not used for the dictionaries.

Defined results: a null text is empty, an empty text gets the calibrated score of size 0; a long text is read whole, block by
block; rows are independent, so repeated rows score alike; rows of `labels` with a null id or label teach nothing; without
texts of both labels every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import bounded_batches, bucket
from ._text import settled

#: Bytes compressed at once: short enough for a dictionary to matter in every part of a long text.
BLOCK = 512
LEVEL = 3
#: Bounds of the sample that the model is fitted on: texts of each label in each half, and bytes of each such group.
SAMPLE_TEXTS = 2000
SAMPLE_BYTES = 8_000_000
DICTIONARY_BYTES = 262_144
SHRINK = 32.0


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


@dataclass
class QualityModel:
    """Plain data, small and of bounded size: two dictionaries and the calibration."""

    good: bytes = b""
    bad: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def _open(self) -> list[tuple[zstandard.ZstdCompressor, int]]:
        if not hasattr(self, "_tools"):
            tools = []
            for data in (self.good, self.bad):
                trained = data[:4] == b"\x37\xa4\x30\xec"
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
                tools.append((c, len(c.compress(b""))))
            self._tools = tools
        return self._tools

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Normalised size differences of each text, over all blocks and in its worst block: good against bad, good against raw."""
        (good, g0), (bad, b0) = self._open()
        g, b, n, first = [], [], [], []
        for t in texts:
            first.append(len(g))
            for i in range(0, max(1, len(t)), BLOCK):
                part = t[i : i + BLOCK]
                g.append(len(good.compress(part)) - g0)
                b.append(len(bad.compress(part)) - b0)
                n.append(len(part))
        g, b, n, first = (np.array(x, dtype=t) for x, t in ((g, float), (b, float), (n, float), (first, np.int64)))
        out = []
        for x, y in ((b, g), (n, g)):
            whole_x, whole_y = np.add.reduceat(x, first), np.add.reduceat(y, first)
            out += [(whole_x - whole_y) / (whole_x + whole_y + SHRINK), np.minimum.reduceat((x - y) / (x + y + SHRINK), first)]
        return np.stack(out, axis=1)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        k = x.shape[1]
        return np.column_stack([z, *(z[:, i] * z[:, j] for i in range(k) for j in range(i, k)), np.ones(len(z))])

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> None:
        """Penalised logistic fit by Newton steps, each halved until the loss falls."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._design(x)
        loss = lambda w: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ w))).sum() + 0.05 * w @ w
        w = np.zeros(a.shape[1])
        now = loss(w)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            s = weight * p * (1 - p)
            step = np.linalg.solve((a * s[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (weight * (p - y)) + 0.1 * w)
            while (fresh := loss(w - step)) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            w, now = w - step, fresh
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = self.features(texts)
        low, high = self.mean - 8 * self.scale, self.mean + 8 * self.scale
        return 1 / (1 + np.exp(-np.clip(self._design(np.clip(x, low, high)) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout: tuple[int, int] = (3, 1), sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fold (crc32(id) mod holdout[0] == holdout[1]).

    Half of the sample builds the dictionaries, the other half calibrates.  At most `sample_texts` texts and `sample_bytes`
    bytes of each label and half reach the driver, taken in the order of a hash of the id; the ids are chosen and sized before
    any text is collected.
    """
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("quality"))
    known = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"), order.alias("h"))
        .filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & (bucket("i", holdout[0]) != holdout[1]))
        .dropDuplicates(["i", "y"])
        .withColumn("half", F.pmod(F.col("h"), F.lit(2)).cast("int"))
    )
    counts = {(r["y"], r["half"]): r["n"] for r in known.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    seen = sum(counts.values())
    good = sum(n for (y, _), n in counts.items() if y == 1)
    model = QualityModel(prior=good / seen if seen else 0.5)
    if not good or good == seen:
        return model
    spark = docs.sparkSession
    # one scan: the smallest hashes of each group, about twice as many as are taken
    place = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    near = F.lit(False)
    for (y, half), n in counts.items():
        near = near | (F.col("y") == y) & (F.col("half") == half) & (place <= (2 * sample_texts + 100) / n)
    ids, taken = [], Counter()
    for r in sorted(known.filter(near).withColumn("place", place).collect(), key=lambda r: (r["place"], r["i"])):
        taken[r["y"], r["half"]] += 1
        if taken[r["y"], r["half"]] <= sample_texts:
            ids.append(r)
    chosen = spark.createDataFrame([(r["i"], r["y"], r["half"], r["h"]) for r in ids], "i " + dict(labels.dtypes)[id_col] + ", y int, half int, h long")
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sized = texts.join(F.broadcast(chosen), "i").groupBy("i", "y", "half", "h").agg(F.max(F.octet_length("t")).alias("n"), F.min(F.xxhash64("t")).alias("v"))
    total: dict[tuple[int, int], int] = {}
    keep = []
    for r in sorted(sized.collect(), key=lambda r: (r["h"], r["i"])):
        group = (r["y"], r["half"])
        if total.get(group, 0) + r["n"] <= sample_bytes:
            total[group] = total.get(group, 0) + r["n"]
            keep.append((r["i"], r["y"], r["half"], r["h"], r["v"]))
    picked = spark.createDataFrame(keep, chosen.schema.simpleString()[7:-1] + ", v: bigint") if keep else chosen.limit(0).withColumn("v", F.lit(0).cast("bigint"))
    rows = texts.withColumn("v", F.xxhash64("t")).join(F.broadcast(picked), ["i", "v"]).dropDuplicates(["i", "y", "v"]).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["i"], r["y"]))
    groups: dict[tuple[int, int], list[bytes]] = {}
    for r in rows:
        groups.setdefault((r["y"], r["half"]), []).append(r["t"].encode())
    if not groups.get((0, 0)) or not groups.get((1, 0)):  # too few for two halves: both uses share what there is
        merged = {y: groups.get((y, 0), []) + groups.get((y, 1), []) for y in (0, 1)}
        groups = {(y, half): merged[y] for y in (0, 1) for half in (0, 1)}
    if not groups[0, 0] or not groups[1, 0]:
        return model
    model.good, model.bad = dictionary(groups[1, 0]), dictionary(groups[0, 0])
    rest = {y: groups.get((y, 1)) or groups[y, 0] for y in (0, 1)}
    x = np.concatenate([model.features(rest[0]), model.features(rest[1])])
    y = np.r_[np.zeros(len(rest[0])), np.ones(len(rest[1]))]
    share = {k: sum(n for (q, _), n in counts.items() if q == k) / seen for k in (0, 1)}
    weight = np.where(y == 1, share[1] / len(rest[1]), share[0] / len(rest[0])) * len(y)
    model.calibrate(x, y, weight)
    return model


def score_column(spark: SparkSession, model: QualityModel, text: Column | str) -> Column:
    """double: the probability that a text is of label 1."""
    bounded_batches(spark)
    data = spark.sparkContext.broadcast(pickle.dumps(model))
    cache: list[QualityModel] = []

    @F.arrow_udf("double")
    @settled
    def score(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(pickle.loads(data.value))
        out = [np.zeros(0)]
        for k in range(0, len(texts), 500):
            out.append(cache[0].score([(t.as_py() or "").encode() for t in texts[k : k + 500]]))
        return pa.array(np.concatenate(out), pa.float64())

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout: tuple[int, int] = (3, 1)) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; one narrow pass after the fit.  A row with a null id is held out."""
    model = fit(docs, labels, id_col, text_col, label_col, holdout)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(bucket(id_col, holdout[0]) == holdout[1], F.lit(True)).alias("held_out"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    model = fit(docs, labels, id_col, text_col)
    return docs.filter(score_column(docs.sparkSession, model, F.col(text_col)) >= threshold)
