"""Quality by compression: how much better a text packs with a dictionary of good text than with one of bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

#: Bound of the fit: labelled rows per label, half for the dictionaries and half for the calibration,
#: and bytes of text of each label.  Every row is scored, whole.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 32_000_000
#: Size of a dictionary, of the pieces that are packed one by one, and the level of the packer.
DICT_BYTES, PIECE, LEVEL = 112 * 1024, 1024, 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic curve of their size difference; without both labels, a constant."""

    good: bytes
    bad: bytes
    slope: float
    shift: float
    prior: float


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on the fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


@lru_cache(maxsize=4)
def packers(good: bytes, bad: bytes):
    import zstandard

    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(model: Model, text: str | None) -> float:
    """(bad - good) / (bad + good) of the packed sizes of all pieces of the text."""
    raw = (text or "").encode("utf-8", "replace")
    sizes = [0, 0]
    both = packers(model.good, model.bad)
    for at in range(0, len(raw) or 1, PIECE):
        piece = raw[at:at + PIECE]
        for k in (0, 1):
            sizes[k] += len(both[k].compress(piece))
    return (sizes[1] - sizes[0]) / (sizes[1] + sizes[0])


def labelled(labels: DataFrame, label: str = "quality", usable: Column | None = None) -> DataFrame:
    """(doc_id, label) of usable rows, once each."""
    lab = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    return (lab if usable is None else lab.where(usable)).distinct()


def sample(docs: DataFrame, lab: DataFrame) -> DataFrame:
    """At most SAMPLE_ROWS rows and SAMPLE_BYTES bytes of each label, in the order of a hash of the id.

    Texts of more than 1/64 of the bytes come after all others, and one that exceeds them alone is passed over.
    """
    order = F.xxhash64("doc_id", F.lit(7))
    lab = lab.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of documents that are not there take no place
    parts = [lab.where(F.col("label") == k).orderBy(order, "doc_id").limit(SAMPLE_ROWS) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    size = F.octet_length(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("label").orderBy(size > SAMPLE_BYTES // 64, order, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(size <= SAMPLE_BYTES)
    return picked.withColumn("held", F.sum(size).over(w)).withColumn(
        "n", F.row_number().over(w)).where((F.col("held") <= SAMPLE_BYTES) & (F.col("n") <= SAMPLE_ROWS)).select("label", "n", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None) -> Model:
    """Dictionaries from one half of the sample, the curve from the other.

    The sample holds as many rows of either label where both are frequent, so the curve is
    weighted by the labels of all usable rows and a score means the same for any size of input.
    Rows without a label, with a null id or a label other than 0 and 1 teach nothing.
    """
    import zstandard

    lab = labelled(labels, label, usable)
    rows = [(r["label"], r["n"], (r["text"] or "").encode("utf-8", "replace")) for r in sample(docs, lab).collect()]
    found = {r["label"]: r["count"] for r in docs.select("doc_id").join(lab, "doc_id").groupBy("label").count().collect()}
    count = [found.get(k, 0) for k in (0, 1)]
    prior = (count[1] + 1) / (count[0] + count[1] + 1)
    dicts = []
    for k in (0, 1):
        pieces = [r[2][at:at + PIECE] for r in rows if r[0] == k and r[1] % 2 for at in range(0, len(r[2]), PIECE)]
        pieces = [p for p in pieces if len(p) >= 8]
        if not pieces:
            return Model(b"", b"", 0.0, 0.0, prior)
        try:
            dicts.append(zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes())
        except zstandard.ZstdError:  # too few samples to train on: the text itself is the dictionary
            dicts.append(b"".join(pieces)[-DICT_BYTES:])
    model = Model(dicts[1], dicts[0], 0.0, 0.0, prior)
    rest = [r for r in rows if r[1] % 2 == 0] or rows
    x = np.array([difference(model, r[2].decode("utf-8", "replace")) for r in rest])
    y = np.array([r[0] for r in rest], float)
    weight = np.where(y == 1, count[1] / max(1, y.sum()), count[0] / max(1, (1 - y).sum())) * len(rows) / sum(count)
    return Model(dicts[1], dicts[0], *_logistic(x, y, weight), prior)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the curve by Newton steps on smoothed targets."""
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones_like(x)])
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (target - p)) - ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` in 0 to 1, higher for better text; rows never move.

    Null and empty texts pack alike with both dictionaries and get the score of no difference.
    A column named score is replaced.
    """
    keep = [c for c in docs.columns if c != "score"]
    at = keep.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if not m.good:
                s = np.full(b.num_rows, m.prior)
            else:
                d = np.array([difference(m, t.as_py()) for t in b.column(at)])
                s = 1 / (1 + np.exp(-np.clip(m.slope * d + m.shift, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*keep, "score"])

    src = docs.select(*keep)
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))
