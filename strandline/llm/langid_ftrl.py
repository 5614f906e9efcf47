"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of code points are hashed to a table of weights. Document frequencies are counted over every
training row; the model is fitted with follow-the-regularised-leader (per-coordinate rates, L1 and L2
penalties) on a sample of at most ``max_train`` training rows, and its temperature on another bounded
sample that the fit has not seen. The fit runs in one task, which holds at most MAX_ENTRIES n-gram counts of
the sample (rows beyond are not learned from); the driver gets the weights alone. A prediction reads the whole
text and nothing else.

Defined results: null text or text without a letter is ``und`` with score 0; without training rows
every text is ``und``; rows with a null lang are predicted but never learned from; texts of any length are read
whole; repeated rows get equal results and count as often as they occur in training; languages that tie go to
the first by name; an empty table gives an empty table; columns of any name are kept, but ``lang_pred`` and
``score`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, odd_constants, release, text_buffer

#: Samples are bounded: rows that the weights are fitted on, and rows for the temperature.
MAX_TRAIN, MAX_CALIBRATE = 2_000, 1_000
#: Distinct n-grams of all sampled rows that the fit holds (12 bytes each), and languages at most.
MAX_ENTRIES, MAX_LANGUAGES = 8_000_000, 200


class GramHasher:
    """Table places of the character n-grams of a text; case, digits and kinds of space are folded."""

    def __init__(self, bits: int, orders: tuple[int, ...]) -> None:
        self.bits, self.orders = bits, orders
        fold = np.arange(0x250, dtype=np.uint32)
        fold[0x41:0x5B] += 0x20
        fold[0xC0:0xDF] += 0x20
        fold[0x30:0x3A] = 0x30
        fold[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0]] = 0x20
        self.fold = fold
        self.keys = odd_constants(max(orders) + 1, 31)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(place, row) arrays for each order; runs do not cross rows."""
        low, high = int(starts[0]), int(ends.max())
        data = raw[low:high]
        lead = (data & 0xC0) != 0x80
        cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.r_[0, np.cumsum(lead)]
        a, b = at[starts - low], at[np.maximum(ends, starts) - low]
        small = cp < 0x250
        cp = np.where(small, self.fold[np.where(small, cp, 0)], cp).astype(np.uint64)
        shift = np.uint64(64 - self.bits)
        part = np.zeros(len(cp), np.uint64)
        for k in range(max(self.orders)):
            n = max(0, len(cp) - k)
            part = part[:n] + cp[k:] * self.keys[k]
            if k + 1 in self.orders:
                x = part ^ (part >> np.uint64(29))
                yield k, ((x * self.keys[-1]) >> shift).astype(np.int32), a, np.maximum(b - k, a)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # place x language, times idf
    bias: np.ndarray
    temperature: float
    bits: int
    orders: tuple[int, ...]


SCALE = 30.0


def gram_counts(docs: DataFrame, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """(lang, part, draw, idx, n): hashed n-gram counts of each whole text of a bounded sample."""

    def run(batches):
        import pyarrow as pa

        hasher = GramHasher(bits, orders)
        for batch in batches:
            raw, starts, ends = text_buffer(batch.column(3))
            idx, num = [], []
            for i, j in chunks(starts, ends):
                per = [[] for _ in range(j - i)]
                for _, place, a, b in hasher(raw, starts[i:j], ends[i:j]):
                    for d in range(j - i):
                        per[d].append(place[a[d] : b[d]])
                for p in per:
                    u, c = np.unique(np.concatenate(p), return_counts=True)
                    idx.append(u.astype(np.int32))
                    num.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(idx, pa.list_(pa.int32())), pa.array(num, pa.list_(pa.int32()))], ["lang", "part", "draw", "idx", "n"])
            release()

    return docs.select("lang", "part", "draw", "text").mapInArrow(run, "lang string, part string, draw long, idx array<int>, n array<int>")


def document_frequency(docs: DataFrame, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Documents of the whole training set that hold each place; the last entry is their number."""

    def run(batches):
        import pyarrow as pa

        hasher, df, seen = GramHasher(bits, orders), np.zeros((1 << bits) + 1, np.int64), np.zeros(1 << bits, bool)
        for batch in batches:
            raw, starts, ends = text_buffer(batch.column(0))
            for i, j in chunks(starts, ends):
                found = list(hasher(raw, starts[i:j], ends[i:j]))
                for d in range(j - i):
                    seen[:] = False
                    for _, place, a, b in found:
                        seen[place[a[d] : b[d]]] = True
                    df[:-1] += seen
                df[-1] += j - i
            release()
        place = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(df[place], pa.int64())], ["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << bits) + 1, np.int64)  # a bounded table: one count for each place
    out[np.asarray(rows.column("place"))] = np.asarray(rows.column("n"))
    return out


def fit(x: list, y: np.ndarray, classes: int, places: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """FTRL-proximal over (index, value) rows; sparse weights and a bias, whose place is the last."""
    z, n = np.zeros((places + 1, classes)), np.zeros((places + 1, classes))

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(x)):
            i, v = x[k]
            i, v = np.r_[i, places], np.r_[v.astype(float), 1.0]
            w = weights(i)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = v[:, None] * p
            g2 = g * g
            sigma = (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g2
    return weights(slice(None))


def calibrated(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of a grid with the least cross-entropy; 1 without rows."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 60))

    def loss(t):
        s = scores / t
        return (np.logaddexp.reduce(s, axis=1) - s[np.arange(len(s)), truth]).mean()

    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def fit_sample(sample: DataFrame, languages: list[str], idf: np.ndarray, epochs: int, max_entries: int) -> DataFrame:
    """One row (weights, bias, temperature), or none: the model of sample(lang, part, draw, idx, n), fitted in one task."""
    places = len(idf)

    def run(batches):
        import pyarrow as pa

        x, y, on, held = [], [], [], 0
        for batch in batches:
            for lang, part, i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                i, n = np.array(i.values if i.values is not None else [], np.int32), np.array(n.values if n.values is not None else [], np.float64)
                if x and held + len(i) > max_entries:
                    continue
                held += len(i)
                x.append((i, SCALE * idf[i] * n / max(1.0, n.sum())))
                y.append(languages.index(lang))
                on.append(part == "fit")
        if not x:
            return
        y, on = np.array(y), np.array(on)
        if not on.any():
            on[:] = True
        learn, heat = np.flatnonzero(on), np.flatnonzero(~on)
        w = fit([x[k] for k in learn], y[learn], len(languages), places, epochs, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3)
        temperature = calibrated(np.array([x[k][1] @ w[x[k][0]] + w[-1] for k in heat]).reshape(-1, len(languages)), y[heat])
        weights = (w[:-1] * idf[:, None] * SCALE).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [w[-1].tobytes()], "temperature": [temperature]})
        del x, w, weights
        release()

    return sample.repartition(1).sortWithinPartitions("draw", "lang", "idx").mapInArrow(run, "weights binary, bias binary, temperature double")


def train(docs: DataFrame, may_learn: Column, bits: int = 15, orders: tuple[int, ...] = (1, 2, 3, 4), max_train: int = MAX_TRAIN, max_calibrate: int = MAX_CALIBRATE, epochs: int = 3, max_entries: int = MAX_ENTRIES) -> Model | None:
    """Fits on rows of docs(doc_id, text, lang) where ``may_learn`` holds; None if there are none."""
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)).alias("draw"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    df = document_frequency(rows, bits, orders)
    each, held = max_train / len(counts), max_calibrate / len(counts)
    share = F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, float(min(0.7, each / c)))])
    more = F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, float(min(0.3, held / c)))])
    part = F.when(F.col("draw") < share[F.col("lang")] * 1_000_000, F.lit("fit")).when(F.col("draw") >= 1_000_000 - more[F.col("lang")] * 1_000_000, F.lit("heat"))
    sample = gram_counts(rows.withColumn("part", part).where("part is not null"), bits, orders)  # max_train + max_calibrate rows, about 3 % over by chance
    languages = sorted(counts)
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0
    row = fit_sample(sample, languages, idf, epochs, max_entries).head(1)
    if not row:
        return None
    weights = np.frombuffer(row[0]["weights"], np.float32).reshape(-1, len(languages))
    return Model(languages, weights, np.frombuffer(row[0]["bias"], np.float64), row[0]["temperature"], bits, orders)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, from the text alone; other columns are kept."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    columns, text_at = docs.columns, docs.columns.index("text")
    names = [f"c{k}" for k in range(len(columns))]  # whatever the columns are called
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # places x languages floats: bounded by the parameters
    def run(batches):
        import pyarrow as pa

        m = shared.value
        hasher, langs = GramHasher(m.bits, m.orders), [*m.languages, "und"]
        by_class = [np.ascontiguousarray(m.weights[:, c]) for c in range(len(m.languages))]
        for batch in batches:
            column = batch.column(text_at)
            raw, starts, ends = text_buffer(column)
            best, score = np.full(len(column), len(langs) - 1, np.int64), np.zeros(len(column))
            for i, j in chunks(starts, ends):
                total, size = np.zeros((j - i, len(by_class))), np.zeros(j - i)
                for _, place, a, b in hasher(raw, starts[i:j], ends[i:j]):
                    size += b - a
                    if len(place):
                        live = np.flatnonzero(b > a)
                        cut = np.c_[a[live], b[live]].ravel()
                        for c, w in enumerate(by_class):
                            total[live, c] += np.add.reduceat(np.r_[w[place], np.float32(0)], cut, dtype=np.float64)[::2]
                s = (total / np.maximum(size, 1)[:, None] + m.bias) / m.temperature
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            for k, v in enumerate(column.to_pylist()):
                if not v or not (v[:64].isascii() and any(map(str.isalpha, v[:64])) or any(map(str.isalpha, v))):
                    best[k], score[k] = len(langs) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([langs[k] for k in best], pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
            release()

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*columns, "lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
