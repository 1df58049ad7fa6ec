"""Second-order boosted trees over binned features (M6–M8).

Each round grows one tree on the gradients g and hessians h of the logistic
loss: a split's gain is GL²/HL + GR²/HR − G²/H, ``min_child_weight`` is the
least hessian sum of a node, and a leaf's value is −G / (H + l2).

* Split candidates are found once: the midpoints between a feature's values in
  the training rows, or between at most 255 weighted quantiles of them.  Every
  value becomes the number of the candidates below it (one byte).
* The rows lie in blocks (one matrix of bytes a block).  A level of a tree is one
  pass over the blocks: each task adds up G and H by node, feature and bin, and
  the sums are added by piece of features — on the driver while all tasks' sums
  are at most ``DIRECT`` bytes, by a shuffle beyond.
* A tree draws its ``columns`` share of the features once, by round and seed; it
  sees no others.  Of splits with the same gain the first feature's counts.
* Missing values: a feature that has any in the training rows enters twice, its
  gaps below and above every value, so that a split sends them to the side that
  fits better.  Other features' gaps at scoring time go below.
* Stopping by patience: every ``CHUNK`` rounds, and at the first round that can
  be the last, the margins after each round are made in one pass over the
  validation rows; their AUC per round decides.  The first best round is kept
  once ``patience`` rounds bring nothing better.
* Several models of one table (subsets of its features) grow side by side: a pass
  serves the level of all their trees.
* A model whose places of all rows take at most ``ALONE`` bytes is grown by one
  task, to which a shuffle brings them: the same rounds, sums and stopping,
  without a Spark job for every level.  A place's most frequent bin is not summed
  there but has what the others leave of the node, and of two children the one
  with more rows has what the other leaves of their parent.

Margins are brought up to date every ``CHUNK`` rounds in a checkpointed copy of
the blocks and the older copy is removed, so a pass walks at most ``CHUNK`` trees
and a lost executor costs at most that many.  Trees, sums and AUCs are all that
reaches the driver; their size depends on features, bins, rounds and depth alone.
"""

from __future__ import annotations

import math
import random
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from shopcast.operators.evaluate import auc_by
from shopcast.session import checkpoint_dir

BIG = 1e12          # stands for an infinite value
GAP = 4e12          # stands for a missing one, below or above everything else
CHUNK = 10          # most rounds between written margins
LEAST_HESSIAN = 1e-16
POINTS = 4096       # weighted points that stand for a feature's values while its quantiles are found
CELLS = 1 << 22     # values in a block
PIECE = 64          # features whose sums travel together
DIRECT = 1 << 26    # bytes of all tasks' sums that are added on the driver
SAME_GAIN = 1e-9    # gains this near (relatively) are the same
ALONE = 1 << 29     # bytes of a model's bins and entries that one task holds at most
ENTRIES = 1 << 16   # entries that one task adds up at once
FEW = 1024          # rows whose sums are added for a whole piece at once


@dataclass(frozen=True)
class Features:
    """Names of the features and of those that enter with their gaps on either side."""
    names: tuple[str, ...]
    two_sided: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        """The feature behind each place."""
        return [*self.names, *self.two_sided]

    def gap(self, place: int) -> float:
        return -GAP if place < len(self.names) else GAP

    def drawn(self, share: float, seed: int, round_: int) -> frozenset[str]:
        """The features that a round's tree may split on: its share of all, at least one."""
        count = max(1, int(len(self.names) * share))
        if count >= len(self.names):
            return frozenset(self.names)
        return frozenset(random.Random(f"{seed}:{round_}").sample(sorted(self.names), count))


@dataclass
class Tree:
    """Nodes in order of their making; ``place`` is −1 for a leaf.  A row goes left if its value is at most
    ``threshold``, its bin at most ``cut``."""
    place: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    sums: list[tuple[float, float]] = field(default_factory=list)      # G and H of the node
    gain: list[float] = field(default_factory=list)
    features: int = 0

    def add(self, g: float, h: float) -> int:
        for values, x in ((self.place, -1), (self.threshold, 0.0), (self.cut, 0), (self.left, 0), (self.right, 0),
                          (self.sums, (g, h)), (self.gain, 0.0)):
            values.append(x)
        return len(self.place) - 1

    def pack(self) -> None:
        """Plain arrays in place of the lists of a grown tree: the driver holds thousands."""
        for name, kind in (("place", "i"), ("threshold", "d"), ("cut", "i"), ("left", "i"), ("right", "i"), ("gain", "d")):
            setattr(self, name, array(kind, getattr(self, name)))
        self.sums = np.array(self.sums)

    def leaves(self, node: int = 0) -> list[int]:
        """The leaves' nodes from left to right."""
        if self.place[node] < 0:
            return [node]
        return self.leaves(self.left[node]) + self.leaves(self.right[node])

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (named as in Spark ML)
        """Each place's share of all gains."""
        total = np.zeros(self.features)
        np.add.at(total, [p for p in self.place if p >= 0], [g for p, g in zip(self.place, self.gain, strict=True) if p >= 0])
        return Vectors.dense(total / total.sum() if total.any() else total)

    @property
    def toDebugString(self) -> str:  # noqa: N802 (named as in Spark ML)
        def lines(node: int, pad: str) -> list[str]:
            if self.place[node] < 0:
                return [f"{pad}Predict: {self.sums[node]}"]
            f, t = self.place[node], self.threshold[node]
            return [f"{pad}If (feature {f} <= {t})", *lines(self.left[node], pad + " "),
                    f"{pad}Else (feature {f} > {t})", *lines(self.right[node], pad + " ")]
        return "\n".join(lines(0, ""))


def _walk(rows: np.ndarray, place: np.ndarray, limit: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The node that each row (a column of ``rows``) ends in."""
    node, at = np.zeros(rows.shape[1], np.intp), np.arange(rows.shape[1])
    while True:
        inner = place[node] >= 0
        if not inner.any():
            return node
        down = np.where(rows[place[node], at] <= limit[node], left[node], right[node])
        node = np.where(inner, down, node)


@dataclass
class Boosted:
    """Fitted trees with their leaf values (learning rate included), in order of the rounds."""
    features: Features
    trees: list[Tree] = field(default_factory=list)
    values: list[list[float]] = field(default_factory=list)
    aucs: list[float] = field(default_factory=list)
    rounds_run: int = 0
    columns: float = 1.0
    seed: int = 0

    def cut(self, rounds: int) -> Boosted:
        """The model after its first ``rounds`` rounds."""
        return Boosted(self.features, self.trees[:rounds], self.values[:rounds], self.aucs, self.rounds_run, self.columns, self.seed)

    @property
    def draws(self) -> list[frozenset[str]]:
        """The features that each tree may split on."""
        return [self.features.drawn(self.columns, self.seed, i) for i in range(len(self.trees))]

    def walks(self, places: list[int] | None = None, by_bin: bool = False) -> list[tuple]:
        """Arrays of each tree for ``_walk`` (``places``: where the places lie in the rows), and its nodes' values."""
        return [_arrays(t, places, by_bin, v) for t, v in zip(self.trees, self.values, strict=True)]

    def predict(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Probability of class 1."""
        return predict_all([self], df, [out])

    def split_counts(self, spark: SparkSession) -> DataFrame:
        """(feature, splits): how often the trees split on each feature (one row a feature)."""
        counts = dict.fromkeys(self.features.names, 0)
        columns = self.features.columns
        for tree in self.trees:
            for p in tree.place:
                if p >= 0:
                    counts[columns[p]] += 1
        return spark.createDataFrame(list(counts.items()), "feature string, splits long")


def _arrays(tree: Tree, places: list[int] | None, by_bin: bool, values: list[float] | None = None) -> tuple:
    where = [p if p < 0 or places is None else places[p] for p in tree.place]
    at = np.zeros(len(where))
    if values is not None:
        at[tree.leaves()] = values
    return (np.array(where, np.intp), np.array(tree.cut if by_bin else tree.threshold), np.array(tree.left, np.intp),
            np.array(tree.right, np.intp), at)


def _margin(rows: np.ndarray, walks: list[tuple], start: np.ndarray) -> np.ndarray:
    for *arrays, values in walks:
        start = start + values[_walk(rows, *arrays)]
    return start


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-margin))


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A feature's values; gaps are NaN and infinite ones ±BIG."""
    x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(np.isinf(x), np.copysign(BIG, x), x)


def _numbers(df: DataFrame, names) -> list[Column]:
    """The features under names by place (no copy); what is no number is cast to one."""
    number = {c: isinstance(df.schema[c].dataType, S.NumericType) and not isinstance(df.schema[c].dataType, S.DecimalType)
              for c in names}
    return [(F.col(f"`{c}`") if number[c] else F.col(f"`{c}`").cast("double")).alias(f"_f{i}") for i, c in enumerate(names)]


def predict_all(models: list[Boosted], df: DataFrame, outs: list[str]) -> DataFrame:
    """``df`` with each model's probability of class 1, in one pass."""
    used = [sorted({p for t in m.trees for p in t.place if p >= 0}) for m in models]
    work = []
    for m, places in zip(models, used, strict=True):
        index = [0] * len(m.features.columns)
        for i, p in enumerate(places):
            index[p] = i
        work.append(([(df.columns.index(m.features.columns[p]), m.features.gap(p)) for p in places], m.walks(index)))
    number = [isinstance(f.dataType, S.NumericType) and not isinstance(f.dataType, S.DecimalType) for f in df.schema]
    needed = {i for columns, _ in work for i, _ in columns}
    cast = sorted(i for i in needed if not number[i])        # beside the columns as they are
    at = {i: len(df.columns) + k for k, i in enumerate(cast)}
    work = [([(at.get(i, i), gap) for i, gap in columns], walks) for columns, walks in work]
    wide = df.select("*", *[F.col(f"`{df.columns[i]}`").cast("double").alias(f"_d{i}") for i in cast])
    kept, names = len(df.columns), [*df.columns, *outs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for columns, walks in work:
                rows = np.empty((max(1, len(columns)), b.num_rows))
                for k, (i, gap) in enumerate(columns):
                    x = _values(b.column(i))
                    rows[k] = np.where(np.isnan(x), gap, x)
                found.append(pa.array(_sigmoid(_margin(rows, walks, np.zeros(b.num_rows)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *found], names=names)

    schema = S.StructType([*df.schema.fields, *[S.StructField(o, S.DoubleType()) for o in outs]])
    return wide.mapInArrow(run, schema)


def best_round(aucs: list[float], patience: int | None) -> tuple[int, bool]:
    """The first best round (from 1), and whether ``patience`` rounds after it brought nothing better."""
    best = 0
    for i, auc in enumerate(aucs):
        if auc > aucs[best]:
            best = i
        elif patience is not None and i - best >= patience:
            return best + 1, True
    return best + 1, False


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---- split candidates ----------------------------------------------------------------------------------

def _points(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights, as at most ``most`` points of like weight if there are more."""
    values, inverse = np.unique(values, return_inverse=True)
    weights = np.bincount(inverse.ravel(), weights, len(values))
    if len(values) > most:
        upto = np.cumsum(weights)
        piece = np.minimum((upto - weights / 2) * most / upto[-1], most - 1).astype(np.int64)
        ends = np.append(np.flatnonzero(np.diff(piece)), len(piece) - 1)
        weights = np.diff(upto[ends], prepend=0.0)
        values = values[ends]
    return values, weights


def _thresholds(values: np.ndarray, weights: np.ndarray, splits: int) -> np.ndarray:
    """Midpoints between neighbouring values: all, or those nearest to ``splits`` equal shares of the weight."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= splits:
        return middle
    upto, stride = np.cumsum(weights), weights.sum() / (splits + 1)
    target, chosen = stride, []
    for i, (before, after) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
        if abs(before - target) < abs(after - target):
            chosen.append(i)
            target += stride
    return middle[chosen[:splits]]


@dataclass
class Binned:
    """The blocks of a table's rows and the split candidates of each place."""
    features: Features
    thresholds: list[np.ndarray]
    path: str
    fitted: int         # rows to train on

    def places(self, names) -> list[int]:
        """The places of a subset of the features, in its own order."""
        at = {c: i for i, c in enumerate(self.features.names)}
        twice = {c: len(at) + i for i, c in enumerate(self.features.two_sided)}
        return [at[c] for c in names] + [twice[c] for c in self.features.two_sided if c in set(names)]


def _candidates(rows: DataFrame, names: list[str], bins: int) -> tuple[Features, list[np.ndarray], int]:
    """The features with gaps, every place's candidates and the number of rows to train on.
    Each task hands on at most ``POINTS`` points a feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], []
        points = [(np.zeros(0), np.zeros(0))] * len(names)
        waiting: list[list] = [[] for _ in names]
        gaps, gap_weight, size = np.zeros(len(names), bool), np.zeros(len(names)), 0

        def merge() -> None:
            keep = ~np.concatenate(held)
            w = np.concatenate(weight)[keep]
            for i, parts in enumerate(waiting):
                x = np.concatenate(parts)
                gaps[i] |= bool(np.isnan(x).any())
                x = x[keep]
                lacks = np.isnan(x)
                gap_weight[i] += w[lacks].sum()
                points[i] = _points(np.concatenate((points[i][0], x[~lacks])), np.concatenate((points[i][1], w[~lacks])), POINTS)
                parts.clear()
            held.clear()
            weight.clear()

        waiting_rows = 0
        for b in batches:
            h, w = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (1, 2))
            y = b.column(b.num_columns - 3).to_numpy(zero_copy_only=False)
            if np.isnan(y[~h]).any():
                raise ValueError("a row to train on has no label")
            held.append(h)
            weight.append(w)
            size += int((~h).sum())
            for i in range(len(names)):
                waiting[i].append(_values(b.column(i)))
            waiting_rows += b.num_rows
            if waiting_rows * len(names) >= CELLS:
                merge()
                waiting_rows = 0
        if waiting_rows:
            merge()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(names)), pa.int32()), pa.array([b"", *[p[0].tobytes() for p in points]], pa.binary()),
             pa.array([b"", *[p[1].tobytes() for p in points]], pa.binary()), pa.array([False, *gaps.tolist()]),
             pa.array([float(size), *gap_weight.tolist()])], names=["place", "x", "w", "gaps", "gap_weight"])

    def merged(a: tuple, b: tuple) -> tuple:
        return (*_points(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])), POINTS), a[2] or b[2], a[3] + b[3])

    found = rows.mapInArrow(run, "place int, x binary, w binary, gaps boolean, gap_weight double").rdd.map(
        lambda r: (r.place, (np.frombuffer(r.x), np.frombuffer(r.w), r.gaps, r.gap_weight))).reduceByKey(merged)
    fitted = found.filter(lambda kv: kv[0] < 0).map(lambda kv: kv[1][3])

    def cut(size: float):
        def of(v: tuple) -> tuple:
            x, w, gaps, lacking = v
            splits = max(0, min(bins, int(size)) - 1)
            both = []
            for gap in (-GAP, GAP):
                values, weights = (x, w) if not lacking else _points(np.append(x, gap), np.append(w, lacking), len(x) + 1)
                both.append(_thresholds(values, weights, splits))
            return gaps, both
        return of

    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    size = sum(fitted.collect())
    cuts = dict(found.filter(lambda kv: kv[0] >= 0).mapValues(cut(size)).collect())       # at most 255 numbers a place
    found.unpersist()
    if not cuts:
        return Features(tuple(names)), [np.zeros(0)] * len(names), 0
    two_sided = [i for i in range(len(names)) if cuts[i][0]]
    thresholds = [cuts[i][1][0] for i in range(len(names))] + [cuts[i][1][1] for i in two_sided]
    return Features(tuple(names), tuple(names[i] for i in two_sided)), thresholds, int(size)


def binned(train: DataFrame, cols, label: str, pos_weight: float, validation: Column | None, bins: int) -> Binned:
    """The table's candidates and its rows as blocks, written under the shared folder."""
    spark, names = train.sparkSession, list(cols)
    held = F.lit(False) if validation is None else F.coalesce(validation, F.lit(False))
    y = F.col(label).cast("double")
    rows = train.select(*_numbers(train, names), y.alias("_y"),
                        F.when(y == 1, F.lit(float(pos_weight))).otherwise(1.0).alias("_w"), held.alias("_held"))
    spec, thresholds, fitted = _candidates(rows, names, bins)
    index = {c: i for i, c in enumerate(names)}
    source = [(index[c], spec.gap(p)) for p, c in enumerate(spec.columns)]
    most = max(1, CELLS // max(1, len(source)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list] = {False: [], True: []}

        def block(flag: bool) -> pa.RecordBatch:
            parts, kept[flag] = kept[flag], []
            codes, ys, ws = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
            return pa.RecordBatch.from_arrays(
                [pa.array([flag]), pa.array([len(ys)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (codes, ys, ws)]],
                names=["held", "n", "bins", "y", "w"])

        for b in batches:
            codes = np.empty((len(source), b.num_rows), np.uint8)
            for p, (i, gap) in enumerate(source):
                x = _values(b.column(i))
                codes[p] = np.searchsorted(thresholds[p], np.where(np.isnan(x), gap, x), "left")
            y, w, h = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (3, 2, 1))
            for flag in (False, True):
                for lo in range(0, b.num_rows, most):
                    some = np.flatnonzero(h[lo:lo + most] == flag) + lo
                    if len(some):
                        kept[flag].append((codes[:, some], y[some], w[some]))
                    if sum(len(p[1]) for p in kept[flag]) >= most:
                        yield block(flag)
        for flag in (False, True):
            if kept[flag]:
                yield block(flag)

    path = f"{checkpoint_dir(spark).rstrip('/')}/staged/boosting-{uuid.uuid4().hex}"
    rows.mapInArrow(run, BLOCK).write.parquet(path)
    return Binned(spec, thresholds, path, fitted)


BLOCK = "held boolean, n int, bins binary, y binary, w binary"


# ---- growing -------------------------------------------------------------------------------------------

def _histograms(blocks, work: dict) -> Iterator[tuple]:
    """((model, piece), sums) of a task's rows: G and H by place of the piece, open node and bin; piece −1: by node."""
    sums: dict = {}

    def add(key, x: np.ndarray) -> None:
        sums[key] = sums[key] + x if key in sums else x

    for held, codes, y, w, margins in blocks:
        if held:
            continue
        for k, (walks, tree, slots, pieces) in work.items():
            p = _sigmoid(_margin(codes, walks, margins[k]))
            g, h = w * (y - p), w * np.maximum(p * (1 - p), LEAST_HESSIAN)
            slot, some, count = slots[_walk(codes, *tree[:4])], codes, slots.max() + 1
            here = slot >= 0
            if not here.all():
                some, slot, g, h = codes[:, here], slot[here], g[here], h[here]
            add((k, -1), np.stack([np.bincount(slot, x, count) for x in (g, h)]))
            for i, (places, bins) in enumerate(pieces):
                add((k, i), _sums(some, places, bins, slot, count, g, h))
    return iter(sums.items())


def _sums(codes: np.ndarray, places: list[int], bins: int, slot: np.ndarray, count: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """G and H of rows whose nodes are ``slot``, by place, node and bin."""
    if len(slot) <= FEW:
        at = codes[places].astype(np.intp) + (slot * bins + (np.arange(len(places)) * count * bins)[:, None])
        at, size = at.ravel(), len(places) * count * bins
        return np.stack([np.bincount(at, np.tile(x, len(places)), size) for x in (g, h)])
    out, first = np.empty((2, len(places), count * bins)), slot * bins
    for i, p in enumerate(places):
        at = first + codes[p]
        out[0, i], out[1, i] = np.bincount(at, g, count * bins), np.bincount(at, h, count * bins)
    return out.reshape(2, -1)


def _best(sums: np.ndarray, places: list[int], bins: int, least: float) -> list[tuple | None]:
    """For each open node the piece's best split, (gain, place, cut, GL, HL, GR, HR), or none."""
    g, h = np.cumsum(sums.reshape(2, len(places), -1, bins), axis=3)
    gl, hl, gr, hr = g[..., :-1], h[..., :-1], g[..., -1:] - g[..., :-1], h[..., -1:] - h[..., :-1]
    low = max(least * (1 - 1e-9), np.finfo(float).smallest_subnormal)      # and over 0
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = gl * gl / hl + gr * gr / hr
        gain = apart - g[..., -1:] ** 2 / h[..., -1:]
        good = (hl >= low) & (hr >= low) & (gain > 1e-10 * apart) & (gain > 1e-14 * h[..., -1:])
    gain = np.where(good, gain, 0.0)
    found = []
    for n, most in enumerate(gain.max(axis=(0, 2)).tolist()):
        if not most > 0:
            found.append(None)
            continue
        near = gain[:, n] >= most * (1 - SAME_GAIN)
        p = min(np.flatnonzero(near.any(axis=1)).tolist(), key=places.__getitem__)
        c = int(np.argmax(near[p]))
        at = p, n, c
        found.append((float(gain[at]), places[p], c, *(float(x[at]) for x in (gl, hl, gr, hr))))
    return found


def _first_best(found: list[tuple | None]) -> tuple | None:
    """The split of the first place within reach of the best gain."""
    found = [f for f in found if f]
    most = max((f[0] for f in found), default=0.0)
    return min((f for f in found if f[0] >= most * (1 - SAME_GAIN)), key=lambda f: f[1], default=None)


@dataclass
class _Growth:
    """One model on the way: its places in the blocks and the round's tree."""
    model: Boosted
    places: list[int]
    stop: bool = False
    last: int | None = None
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    total: float = 0.0
    share: float = 0.0
    pieces: list[tuple[list[int], list[int], int]] = field(default_factory=list)    # places, those in the blocks, most bins

    def begin(self, thresholds, columns: float, seed: int) -> None:
        """The next round's draw and its pieces."""
        features = self.model.features
        drawn = features.drawn(columns, seed, len(self.model.trees))
        usable = sorted((len(thresholds[b]) + 1, p, b) for p, (b, c) in enumerate(
            zip(self.places, features.columns, strict=True)) if c in drawn and len(thresholds[b]))
        pieces: list[list] = []         # of places with like numbers of bins
        for x in usable:
            if not pieces or len(pieces[-1]) == PIECE or x[0] > max(8, 2 * pieces[-1][0][0]):
                pieces.append([])
            pieces[-1].append(x)
        self.pieces = [([p for _, p, _ in x], [b for _, _, b in x], x[-1][0]) for x in pieces]
        self.model.columns, self.model.seed = columns, seed
        self.tree, self.open = Tree(features=len(self.places)), [0]
        self.tree.add(0.0, 0.0)

    def weigh(self, g: float, h: float, min_child_weight: float) -> None:
        """The sums of the root."""
        self.tree.sums[0] = g, h
        self.total = h
        self.share = min_child_weight / h

    @property
    def least(self) -> float:
        return min(self.share, 0.4999) * self.total

    def split(self, found: list[list[tuple | None]], thresholds) -> list[int]:
        """Splits the open nodes by the best of the pieces' splits; their children are open then.
        Returns which of the open nodes were split."""
        done, following, tree = [], [], self.tree
        if self.share < 0.5:
            for n, node in enumerate(self.open):
                best = _first_best([piece[n] for piece in found])
                if best:
                    gain, place, cut, gl, hl, gr, hr = best
                    tree.place[node], tree.cut[node], tree.gain[node] = place, cut, gain
                    tree.threshold[node] = float(thresholds[self.places[place]][cut])
                    tree.left[node], tree.right[node] = tree.add(gl, hl), tree.add(gr, hr)
                    following += [tree.left[node], tree.right[node]]
                    done.append(n)
        self.open = following
        return done

    def end(self, rate: float, l2: float) -> None:
        """The tree and its leaves' values join the model."""
        self.model.trees.append(self.tree)
        self.model.values.append([rate * g / (h + l2) for g, h in (self.tree.sums[n] for n in self.tree.leaves())])
        self.tree.pack()


def _grow(state: RDD, growths: dict[int, _Growth], start: int, depth: int, min_child_weight: float, thresholds) -> None:
    """The round's tree of every model, level by level; ``start``: rounds that the margins hold."""
    walks = {}
    for k, m in growths.items():
        since = Boosted(m.model.features, m.model.trees[start:], m.model.values[start:])
        walks[k] = since.walks(m.places, True)
    for level in range(max(1, depth)):
        work, shapes, bytes_ = {}, {}, 0
        for k, m in growths.items():
            if not m.open:
                continue
            slots = np.full(len(m.tree.place), -1, np.intp)
            slots[m.open] = np.arange(len(m.open))
            pieces = m.pieces if depth else []
            work[k] = (walks[k], _arrays(m.tree, m.places, True), slots, [(b, n) for _, b, n in pieces])
            shapes[k] = [(p, n) for p, _, n in pieces]
            bytes_ += 16 * len(m.open) * sum(len(p) * n for p, n in shapes[k])
        if not work:
            return
        parts = state.mapPartitions(lambda blocks, work=work: _histograms(blocks, work))
        if bytes_ * parts.getNumPartitions() <= DIRECT:
            sums: dict = {}
            for key, x in parts.collect():
                sums[key] = sums[key] + x if key in sums else x
            nodes = {k: x for (k, i), x in sums.items() if i < 0}
            pieces = {key: x for key, x in sums.items() if key[1] >= 0}
        else:
            merged = parts.reduceByKey(lambda a, b: a + b).persist(StorageLevel.MEMORY_AND_DISK)
            nodes = {k: x for (k, i), x in merged.filter(lambda kv: kv[0][1] < 0).collect()}
            pieces = None
        for k in work:
            m = growths[k]
            if level == 0:
                m.weigh(*nodes[k][:, 0].tolist(), min_child_weight)
        least = {k: growths[k].least for k in work}
        if pieces is None:
            found = dict(merged.filter(lambda kv: kv[0][1] >= 0).map(
                lambda kv: (kv[0], _best(kv[1], *shapes[kv[0][0]][kv[0][1]], least[kv[0][0]]))).collect())
            merged.unpersist()
        else:
            found = {(k, i): _best(x, *shapes[k][i], least[k]) for (k, i), x in pieces.items()}
        for k in work:
            growths[k].split([found[k, i] for i in range(len(shapes[k]))], thresholds)


def fit_all(train: DataFrame, cols, subsets, label: str = "label", rounds: int = 100, depth: int = 3, rate: float = 0.1,
            min_child_weight: float = 1.0, l2: float = 1.0, pos_weight: float = 1.0, columns: float = 1.0,
            validation: Column | None = None, patience: int | None = None, bins: int = 256, seed: int = 0) -> list[Boosted]:
    """One model for each of ``subsets`` of the features ``cols``, as ``fit_boosted`` fits it, side by side."""
    data = binned(train, cols, label, pos_weight, validation, bins)
    models = fit_binned(train.sparkSession, data, subsets, rounds, depth, rate, min_child_weight, l2, columns, patience, seed)
    remove_binned(train.sparkSession, data)
    return models


def remove_binned(spark: SparkSession, data: Binned) -> None:
    _remove(spark, data.path)


def fit_binned(spark: SparkSession, data: Binned, subsets, rounds: int = 100, depth: int = 3, rate: float = 0.1,
               min_child_weight: float = 1.0, l2: float = 1.0, columns: float = 1.0, patience: int | None = None,
               seed: int = 0) -> list[Boosted]:
    """``fit_all`` on a table's blocks, which stay."""
    growths = []
    for subset in subsets:
        twice = set(subset).intersection(data.features.two_sided)
        spec = Features(tuple(subset), tuple(c for c in data.features.two_sided if c in twice))
        growths.append(_Growth(Boosted(spec), data.places(subset), stop=not data.fitted))
    blocks = spark.read.schema(BLOCK).parquet(data.path)
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).first()
    small = [((size.n or 0) + 8 * data.fitted) * len(m.places) <= ALONE for m in growths]
    alone, apart = ([m for m, one in zip(growths, small, strict=True) if one is flag] for flag in (True, False))
    options = dict(rounds=rounds, depth=depth, rate=rate, min_child_weight=min_child_weight, l2=l2, columns=columns,
                   patience=patience, seed=seed)
    if data.fitted and alone:
        _fit_alone(blocks, data, alone, **options)
    if data.fitted and apart:
        _fit_apart(spark, blocks.repartition(max(1, min(size.blocks, spark.sparkContext.defaultParallelism))), data, apart, **options)
    models = []
    for m in growths:
        model = m.model
        model.rounds_run = len(model.trees)
        if patience is not None and model.trees:
            best, stopped = best_round(model.aucs, patience)
            model.rounds_run = min(best + patience, model.rounds_run) if stopped else model.rounds_run
            model = model.cut(best)
        models.append(model)
    return models


def _fit_apart(spark: SparkSession, spread: DataFrame, data: Binned, models: list[_Growth], rounds: int, depth: int, rate: float,
               min_child_weight: float, l2: float, columns: float, patience: int | None, seed: int) -> None:
    """Grows the models level by level in passes over the blocks that ``spread`` deals out."""
    count, wide, growths = len(models), len(data.features.columns), dict(enumerate(models))
    state = spread.rdd.map(lambda r: (r.held, np.frombuffer(r.bins, np.uint8).reshape(wide, r.n), np.frombuffer(r.y),
                                      np.frombuffer(r.w), np.zeros((count, r.n)))).persist(StorageLevel.MEMORY_AND_DISK)
    start, written = 0, None
    while True:
        active = {k: m for k, m in growths.items() if not m.stop and len(m.model.trees) < rounds}
        if not active:
            break
        done = len(next(iter(active.values())).model.trees)
        if done - start == CHUNK:
            state, written = _brought_up(spark, state, growths, start, written)
            start = done
        for m in active.values():
            m.begin(data.thresholds, columns, seed)
        _grow(state, active, start, depth, min_child_weight, data.thresholds)
        for m in active.values():
            m.end(rate, l2)
        done += 1
        due = {k: m for k, m in active.items() if done - start == CHUNK or done in (rounds, m.last)}
        if patience is not None and due:
            for k, aucs in _aucs(spark, state, due, start).items():
                m = growths[k]
                m.model.aucs += aucs
                best, m.stop = best_round(m.model.aucs, patience)
                m.last = best + patience        # the first round that can end the fit
    state.unpersist()
    if written:
        _remove(spark, written)


# ---- models that one task grows ------------------------------------------------------------------------

def _fit_alone(blocks: DataFrame, data: Binned, models: list[_Growth], **options) -> None:
    """Grows each model in a task of its own; what reaches the driver are trees, leaf values and AUCs."""
    wide, wanted = len(data.features.columns), [m.places for m in models]
    specs = [m.model.features for m in models]
    thresholds = [[data.thresholds[b] for b in places] for places in wanted]

    def deal(r) -> Iterator[tuple]:
        codes = np.frombuffer(r.bins, np.uint8).reshape(wide, r.n)
        for k, places in enumerate(wanted):
            yield k, (r.held, codes[places].tobytes(), r.n, bytes(r.y), bytes(r.w))

    def fit(pairs: Iterator[tuple]) -> Iterator[tuple]:
        mine: dict[int, list] = {}
        for k, block in pairs:
            mine.setdefault(k, []).append(block)
        for k in sorted(mine):
            yield k, _grown(specs[k], mine.pop(k), thresholds[k], **options)

    for k, model in blocks.rdd.flatMap(deal).partitionBy(len(models), int).mapPartitions(fit).collect():
        models[k].model = model


def _grown(spec: Features, blocks: list[tuple], thresholds: list[np.ndarray], rounds: int, depth: int, rate: float,
           min_child_weight: float, l2: float, columns: float, patience: int | None, seed: int) -> Boosted:
    """The model of ``blocks`` (held, bins of its places, rows, y, w), which may come in any order."""
    blocks.sort()
    m, wide = _Growth(Boosted(spec), list(range(len(spec.columns)))), len(spec.columns)

    def rows(flag: bool) -> tuple:
        some = [b for b in blocks if b[0] == flag]
        codes = [np.frombuffer(c, np.uint8).reshape(wide, n) for _, c, n, _, _ in some]
        return (np.concatenate(codes, axis=1) if codes else np.zeros((wide, 0), np.uint8),
                *(np.frombuffer(b"".join(b[i] for b in some)) for i in (3, 4)))

    (codes, y, w), (held, truth, _) = rows(False), rows(True)
    blocks.clear()
    entries = _Entries(codes, [len(t) + 1 for t in thresholds])
    margin, held_margin = np.zeros(len(y)), np.zeros(len(truth))
    while not m.stop and len(m.model.trees) < rounds:
        m.begin(thresholds, columns, seed)
        p = _sigmoid(margin)
        parts = _grow_alone(m, entries, w * (y - p), w * np.maximum(p * (1 - p), LEAST_HESSIAN), depth, min_child_weight, thresholds)
        m.end(rate, l2)
        for leaf, value in zip(m.tree.leaves(), m.model.values[-1], strict=True):
            margin[parts[leaf]] += value
        if patience is not None:
            held_margin = _margin(held, [_arrays(m.tree, None, True, m.model.values[-1])], held_margin)
            m.model.aucs.append(_auc(held_margin, truth == 1))
            m.stop = best_round(m.model.aucs, patience)[1]
    return m.model


class _Entries:
    """Rows to train on as their bins' numbers (over all places), without each place's most frequent bin; in order of the
    rows, and the rows in order of the bins."""

    def __init__(self, codes: np.ndarray, bins: list[int]) -> None:
        wide, n = codes.shape
        self.codes, self.bins = codes, np.array(bins, np.int64)
        self.first = np.cumsum(self.bins) - self.bins
        self.size = int(self.bins.sum())
        counts = [np.bincount(c, minlength=b) for c, b in zip(codes, bins, strict=True)]
        self.frequent = np.array([int(c.argmax()) for c in counts], np.int64)
        total = sum(int(c.sum() - c.max()) for c in counts)
        # by bin: pieces of whole bins, each with its rows and where its bins begin
        self.by_bin, rows, ends, numbers, size = [], [], [], [], 0
        for p, count in enumerate(counts):
            order, upto = np.argsort(codes[p], kind="stable").astype(np.int32), np.cumsum(count)
            for b in np.flatnonzero(count).tolist():
                if b != self.frequent[p]:
                    rows.append(order[upto[b] - count[b]:upto[b]])
                    numbers.append(int(self.first[p]) + b)
                    ends.append(size)
                    size += int(count[b])
            if size >= ENTRIES or (size and p + 1 == wide):
                self.by_bin.append((np.concatenate(rows), np.array(ends), np.array(numbers)))
                rows, ends, numbers, size = [], [], [], 0
        # by row
        self.numbers, self.count, size = np.empty(total, np.int32), np.zeros(n, np.int64), 0
        step = max(1, CELLS // max(1, wide))
        for lo in range(0, n, step):
            some = codes[:, lo:lo + step].T
            row, place = np.nonzero(some != self.frequent)
            self.count[lo:lo + step] = np.bincount(row, minlength=len(some))
            self.numbers[size:size + len(row)] = self.first[place] + some[row, place]
            size += len(row)
        self.begin = np.cumsum(self.count) - self.count

    def root(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """G and H of all rows by bin, with an empty one behind."""
        out = np.zeros((2, 1, self.size + 1))
        both = g + 1j * h       # one look-up a row
        for rows, begin, numbers in self.by_bin:
            found = np.add.reduceat(both.take(rows, mode="clip"), begin)
            out[0, 0, numbers], out[1, 0, numbers] = found.real, found.imag
        return self._completed(out, np.array([[[g.sum()]], [[h.sum()]]]))

    def sums(self, parts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """G and H by part of the rows and bin, with an empty one behind."""
        out, totals = np.zeros((2, len(parts), self.size + 1)), np.zeros((2, len(parts), 1))
        rows, slot = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        for i, x in enumerate((g, h)):
            totals[i, :, 0] = np.bincount(slot, x[rows], len(parts))
        flat, upto = out.reshape(2, -1), np.cumsum(self.count[rows])
        cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, 4 * ENTRIES)[1:]).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            some, count = rows[lo:hi], self.count[rows[lo:hi]]
            if count.any():
                ends = np.cumsum(count)
                at = np.arange(ends[-1]) + np.repeat(self.begin[some] - (ends - count), count)
                at = self.numbers[at] + np.repeat(slot[lo:hi] * (self.size + 1), count)
                for i, x in enumerate((g, h)):
                    flat[i] += np.bincount(at, np.repeat(x[some], count), flat.shape[1])
        return self._completed(out, totals)

    def _completed(self, out: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """With the sums of the most frequent bins: what the others leave of the nodes' ``totals``."""
        if len(self.first):
            out[:, :, self.first + self.frequent] = totals - np.add.reduceat(out[:, :, :-1], self.first, axis=2)
        return out

    def piece(self, places: list[int], bins: int) -> np.ndarray:
        """Numbers of the bins of each place, and of the empty one where it has fewer than ``bins``."""
        b = np.arange(bins)
        return np.where(b < self.bins[places][:, None], self.first[places][:, None] + b, self.size)


def _grow_alone(m: _Growth, entries: _Entries, g: np.ndarray, h: np.ndarray, depth: int, min_child_weight: float,
                thresholds) -> dict[int, np.ndarray]:
    """The round's tree on rows that one task holds; returns the rows of each leaf."""
    m.weigh(float(g.sum()), float(h.sum()), min_child_weight)
    tree, parts, sums = m.tree, {0: np.arange(len(g))}, entries.root(g, h)
    pieces = [(places, bins, entries.piece(places, bins)) for places, _, bins in m.pieces]
    for level in range(depth):
        before = m.open
        done = m.split([_best(sums[:, :, at].transpose(0, 2, 1, 3), places, bins, m.least) for places, bins, at in pieces], thresholds)
        if not done:
            break
        for node in (before[n] for n in done):
            rows = parts.pop(node)
            low = entries.codes[tree.place[node]][rows] <= tree.cut[node]
            parts[tree.left[node]], parts[tree.right[node]] = rows[low], rows[~low]
        if level + 1 < depth:
            fewer = np.array([2 * i + int(len(parts[m.open[2 * i + 1]]) < len(parts[m.open[2 * i]])) for i in range(len(done))])
            both = np.empty((2, len(m.open), sums.shape[2]))
            both[:, fewer] = entries.sums([parts[m.open[i]] for i in fewer], g, h)
            both[:, fewer ^ 1] = sums[:, done] - both[:, fewer]
            sums = both
    return parts


def _auc(score: np.ndarray, positive: np.ndarray) -> float:
    """Area under the ROC curve as ``auc_by`` has it; 0.5 without both classes."""
    values, at = np.unique(score, return_inverse=True)
    yes, no = (np.bincount(at, x, len(values)) for x in (positive, ~positive))
    pairs = yes.sum() * no.sum()
    return float((yes * (np.cumsum(no) - no + no / 2)).sum() / pairs) if pairs else 0.5


def fit_boosted(train: DataFrame, cols, label: str = "label", rounds: int = 100, depth: int = 3, rate: float = 0.1,
                min_child_weight: float = 1.0, l2: float = 1.0, pos_weight: float = 1.0, columns: float = 1.0,
                validation: Column | None = None, patience: int | None = None, bins: int = 256, seed: int = 0) -> Boosted:
    """Fit boosted trees on the logistic loss from margin 0.

    ``pos_weight`` weights the rows of class 1.  Rows where ``validation`` holds
    are not trained on; with ``patience`` they stop the rounds, and the model is
    cut after its best one.  Without validation rows of both classes the AUC is
    0.5 throughout and one round is kept.  An empty table gives a model without trees.
    """
    cols = list(cols)
    return fit_all(train, cols, [cols], label, rounds, depth, rate, min_child_weight, l2, pos_weight, columns, validation,
                   patience, bins, seed)[0]


def _brought_up(spark: SparkSession, state: RDD, growths: dict[int, _Growth], start: int, before: str | None) -> tuple[RDD, str]:
    """The blocks with their margins after all rounds, checkpointed; the copy before is removed."""
    walks = {k: Boosted(m.model.features, m.model.trees[start:], m.model.values[start:]).walks(m.places, True)
             for k, m in growths.items() if not m.stop}

    def run(block: tuple) -> tuple:
        held, codes, y, w, margins = block
        return held, codes, y, w, np.stack([_margin(codes, walks.get(k, []), x) for k, x in enumerate(margins)])

    after = state.map(run).persist(StorageLevel.MEMORY_AND_DISK)
    checkpoint_dir(spark)
    after.checkpoint()
    after.count()
    state.unpersist()
    if before:
        _remove(spark, before)
    return after, after.getCheckpointFile()


def _aucs(spark: SparkSession, state: RDD, due: dict[int, _Growth], start: int) -> dict[int, list[float]]:
    """AUC of the validation rows after each of the rounds that have none yet, in one pass over them."""
    todo = {k: (Boosted(m.model.features, m.model.trees[start:], m.model.values[start:]).walks(m.places, True),
                len(m.model.aucs) - start) for k, m in due.items()}

    def run(block: tuple) -> Iterator[tuple]:
        _, codes, y, _, margins = block
        for k, (walks, known) in todo.items():
            margin = margins[k]
            for i, walk in enumerate(walks):
                margin = _margin(codes, [walk], margin)
                if i >= known:
                    yield k, start + i, y.tolist(), margin.tolist()

    each = spark.createDataFrame(state.filter(lambda b: b[0]).flatMap(run),
                                 "model int, round int, y array<double>, margin array<double>", verifySchema=False)
    rows = each.select("model", "round", F.explode(F.arrays_zip("y", "margin")).alias("r"))
    found = {(r["model"], r["round"]): r.auc
             for r in auc_by(rows, ["model", "round"], F.col("r.margin"), F.col("r.y") == 1).collect()}
    return {k: [0.5 if found.get((k, i)) is None else found[k, i] for i in range(len(m.model.aucs), len(m.model.trees))]
            for k, m in due.items()}
