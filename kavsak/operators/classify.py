"""Linear text classification: TF-IDF channels, truncated SVD, logistic regression, predictions."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .ordinal import ranked

#: Channels: text column, kind of terms, the shortest and longest runs, least document frequency, most terms.
CHANNELS = (("base", "char", 3, 5, 3, 500_000), ("base", "word", 1, 2, 3, 150_000), ("side", "char", 3, 5, 3, 200_000), ("side", "word", 1, 2, 3, 80_000))


#: Letters and digits that words are made of; different terms that a task holds before it hands its counts on.
WORD, HELD = re.compile("[a-z0-9çğıöşü]+"), 300_000


def _counted(text: str | None, kind: str, low: int, high: int) -> Counter:
    """Terms of a text and how often they occur: runs of characters, or of words."""
    out: Counter = Counter()
    if not text:
        return out
    if kind == "char":
        for n in range(low, high + 1):
            out.update(reduce(lambda x, i: map(add, x, text[i:]), range(1, n), text))
        return out
    words = WORD.findall(text)
    for n in range(low, high + 1):
        out.update(map(" ".join, zip(*(words[i:] for i in range(n)))) if n > 1 else words)
    return out


class Features:
    """Sublinear TF-IDF of each channel, of length 1 each, side by side in one sparse vector. Terms are counted where their
    text is: what is shuffled are the terms' sums, and vectors are made from the broadcast vocabulary."""

    def __init__(self, docs: DataFrame, channels=CHANNELS):
        """``docs`` has id and the channels' text columns."""
        self.channels = channels
        kinds = [c[1:4] for c in channels]
        names = ["channel", "term", "df", "tf"]

        def count(batches):
            held: list[tuple[Counter, Counter]] = [(Counter(), Counter()) for _ in kinds]

            def handed():
                for k, (df, tf) in enumerate(held):
                    if df:
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(df), pa.int32()), pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([tf[t] for t in df], pa.int64())], names)
                    df.clear()
                    tf.clear()

            for batch in batches:
                for k, kind in enumerate(kinds):
                    df, tf = held[k]
                    for text in batch.column(f"c{k}").to_pylist():
                        found = _counted(text, *kind)
                        df.update(found.keys())
                        tf.update(found)
                        if len(df) > HELD:
                            yield from handed()
            yield from handed()

        counts = self._texts(docs).drop("id").mapInArrow(count, "channel int, term string, df long, tf long").groupBy("channel", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).persist()
        n, words = docs.count(), None
        for k, (*_, least, most) in enumerate(channels):
            known = counts.where((F.col("channel") == k) & (F.col("df") >= least)).orderBy(F.desc("tf"), "term").limit(most).withColumn("docs", F.lit(n).cast("long"))
            words = known if words is None else words.unionByName(known)
        # numbered by channel and hash; at most the channels' caps
        words = ranked(words.persist().withColumn("_h", F.xxhash64("term")), F.struct("channel", F.shiftright("_h", 57)), ["channel", "_h", "term"], name="at")
        self.words = words.select("channel", "term", "df", "docs", (F.col("at") - 1).cast("int").alias("at")).persist()
        self.size = self.words.count()
        counts.unpersist()

    def _texts(self, docs: DataFrame, *more: str) -> DataFrame:
        """(id, c0, c1, ...): the text of each channel; runs of characters are those of the lower-case text."""
        return docs.select("id", *more, *((F.lower(text) if kind == "char" else F.col(text)).alias(f"c{k}") for k, (text, kind, *_) in enumerate(self.channels)))

    def of(self, docs: DataFrame, *more: str) -> DataFrame:
        """(id, features) and the columns ``more``; a text without known terms has an empty vector."""
        known: list[dict[str, tuple[int, float]]] = [{} for _ in self.channels]
        for r in self.words.toArrow().to_pylist():
            known[r["channel"]][r["term"]] = r["at"], math.log((1 + r["docs"]) / (1 + r["df"])) + 1
        shared = docs.sparkSession.sparkContext.broadcast(known)
        kinds = [c[1:4] for c in self.channels]

        def weigh(batches):
            for batch in batches:
                cells = [[] for _ in range(batch.num_rows)]
                for k, (kind, words) in enumerate(zip(kinds, shared.value)):
                    for row, text in zip(cells, batch.column(f"c{k}").to_pylist()):
                        found = [(words[t], n) for t, n in _counted(text, *kind).items() if t in words]
                        weights = [(at, (1 + math.log(n)) * idf) for (at, idf), n in found]
                        norm = math.sqrt(sum(w * w for _, w in weights))
                        row.extend((at, w / norm) for at, w in weights)
                for row in cells:
                    row.sort()
                first = np.concatenate([[0], np.cumsum([len(r) for r in cells])])
                at, weight = ([c[i] for r in cells for c in r] for i in (0, 1))
                each = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at, pa.int32())), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(weight, pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *more)), *each], ["id", *more, "at", "weight"])

        size = self.size
        vector = F.udf(lambda at, weight: Vectors.sparse(size, at, weight), VectorUDT())
        kept = StructType([docs.schema[c] for c in ("id", *more)]).add("at", ArrayType(IntegerType())).add("weight", ArrayType(DoubleType()))
        rows = self._texts(docs, *more).mapInArrow(weigh, kept)
        # fits and predictions read the vectors many times
        return rows.select("id", *more, vector("at", "weight").alias("features")).persist()


#: Numbers of terms up to which the products of all columns are gathered.
SQUARE = 4096


def svd(rows: DataFrame, k: int, most_rows: int = 200_000, seed: int = 42) -> np.ndarray:
    """The first k right singular vectors of ``features``. With up to ``SQUARE`` terms, those of all rows, from the products of
    their columns in one pass; with more, fitted on a sample of at most ``most_rows`` rows."""
    size = len(rows.select("features").first()[0])
    if size <= SQUARE:
        products = RowMatrix(rows.select("features").rdd.map(lambda r: OldVectors.fromML(r[0])), 0, size).computeGramianMatrix()
        return np.linalg.eigh(products.toArray())[1][:, ::-1][:, :k]
    order = F.xxhash64("id", F.lit(seed))
    fit = rows.orderBy(order, "id").limit(most_rows).select("features").rdd.map(lambda r: OldVectors.fromML(r[0]))
    return RowMatrix(fit).computeSVD(k).V.toArray()


def projected(rows: DataFrame, v: np.ndarray, normalize: bool = True) -> DataFrame:
    """(id, reduced): the rows in the space of ``v``, of length 1."""
    shared = rows.sparkSession.sparkContext.broadcast(v.astype(np.float32))

    def one(x):
        y = np.asarray(x.values, np.float32) @ shared.value[x.indices] if len(x.indices) else np.zeros(shared.value.shape[1], np.float32)
        n = float(np.linalg.norm(y))
        return Vectors.dense(y / n if normalize and n else y)

    return rows.withColumn("reduced", F.udf(one, VectorUDT())("features")).drop("features")


class Classifier:
    """Multinomial logistic regression on labels of any type, read as text."""

    def __init__(self, rows: DataFrame, column: str = "features", balanced: bool = True, reg: float = 1e-4, rounds: int = 30):
        """``rows`` has ``column`` and label; NULL labels aren't learned from."""
        rows = rows.where("label IS NOT NULL").withColumn("label", F.col("label").cast("string"))
        self.labels = StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc").fit(rows)
        rows = self.labels.transform(rows)
        counts = rows.groupBy("label").count()
        n, kinds = counts.agg(F.sum("count"), F.count("*")).first()
        weight = F.lit(float(n)) / (kinds * F.col("count")) if balanced else F.lit(1.0)
        # as many rows as the model has classes; the vectors stay where they are
        rows = rows.join(F.broadcast(counts), "label").withColumn("weight", weight)
        self.model = LogisticRegression(featuresCol=column, labelCol="class", weightCol="weight", maxIter=rounds, regParam=reg, family="multinomial").fit(rows)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``predicted``, the likeliest label, and ``probabilities`` in the order of ``labels``."""
        out = self.model.transform(rows).withColumn("probabilities", vector_to_array("probability"))
        out = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(self.labels.labels)).transform(out)
        return out.drop("rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        PipelineModel([self.labels, self.model]).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Classifier:
        out = cls.__new__(cls)
        out.labels, out.model = PipelineModel.load(path).stages
        assert isinstance(out.labels, StringIndexerModel) and isinstance(out.model, LogisticRegressionModel)
        return out

