"""Quality rules: base rules, then an isolation forest over rule statistics.

The forest's random splits are drawn over the whole range of the labelled rows,
and every clean labelled row is counted in every tree, so that a document whose
statistics lie where no clean row lies is alone after few splits. Its score is
the mean path length over the trees, in steps of 1 / STEPS; the threshold between
kept and rejected is calibrated on all labelled rows.

Nothing is sampled: range, counts and threshold are sums over all labelled
documents. What reaches the driver is a row a leaf and a row a path length,
whatever the corpus. A labelled identifier with several rows counts once, with
its smallest ratios.

Nulls and empty texts have no words and fail the base rules. Without labelled
rows, or without rejected ones among them, only the base rules decide. Repeated
rows get the same verdict each; extra columns are ignored or passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, durable, fields, map_texts, texts, with_results

SYMBOLS = b"#*$%&|<>"
TAIL = bytes(range(0x80, 0xC0))  # bytes inside a code point, but the first
UPPER = bytes(range(65, 91))
#: Base statistics, in the order of the columns of statistics().
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Path lengths are multiples of one in STEPS, so that all labelled rows are a bounded number of lengths with counts.
STEPS = 1024
RATIOS = ("symbols", "dup_lines", "repeats", "capitals", "exclaims", "bars", "stutters")


def _ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    get = known.setdefault
    return np.fromiter((get(w, len(known)) for w in words), dtype=np.uint64, count=len(words))


def _covered(hit: np.ndarray, window: int) -> int:
    """Positions inside any of the windows that begin where hit is set."""
    at = np.flatnonzero(hit)
    return int(np.minimum(np.diff(at), window).sum()) + window if len(at) else 0


def repeat_words(docs: list[list[bytes]], window: int = 8) -> list[int]:
    """Words in windows that a text has twice or more. Hashes find the texts, the words decide."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    ids = _ids([w for d in docs for w in d], known)
    if len(ids) < window:
        return [0] * len(docs)
    doc = np.repeat(np.arange(len(docs)), sizes)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - window + 1
    h = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(window):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    h ^= h >> np.uint64(31)
    whole = doc[:n] == doc[window - 1 :]
    h, own = h[whole], doc[:n][whole]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = [0] * len(docs)
    if len(twice):
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for d in np.unique(own[np.isin(h, twice)]).tolist():
            w = ids[starts[d] : starts[d + 1]].tolist()
            grams = list(zip(*(w[j:] for j in range(window))))
            seen = Counter(grams)
            out[d] = _covered(np.fromiter((seen[g] > 1 for g in grams), dtype=bool, count=len(grams)), window)
    return out


def statistics(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics (long) and ratios (double) of each text, one row a text."""
    words = [b.split() for b in raw]
    repeats = repeat_words(words)
    base, ratios = np.zeros((len(raw), len(BASE)), dtype=np.int64), np.zeros((len(raw), len(RATIOS)))
    for r, (b, w) in enumerate(zip(raw, words)):
        lines = [x for x in b.split(b"\n") if x.strip(SPACES)]
        n, size = len(w), len(b)
        chars, symbols, dup = len(b.translate(None, TAIL + SPACES)), size - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines))
        base[r] = n, chars, symbols, dup, repeats[r]
        if n:
            many, long = max(n, 20), max(chars, 100)
            ratios[r] = symbols / long, dup / max(len(lines), 5), repeats[r] / many, (size - len(b.translate(None, UPPER))) / long, b.count(b"!") / many, b.count(b"|") / many, sum(map(eq, w, w[1:])) / many
    return base, np.minimum(ratios, 1.0)


class Forest:
    """Isolation trees in arrays: feature (-1: leaf), split, children; value: the path length at a leaf.

    Trees grow on subsamples of ``clean``; or, with ``counted``, whole trees are drawn first, ``counted``
    tells how many clean rows end in each leaf, and nodes with a row at most become leaves.
    """

    def __init__(self, clean: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, subsample: int, depth: int, seed: int, counted: Callable[[Forest], np.ndarray] | None = None) -> None:
        rng = np.random.default_rng(seed)
        if counted is not None:
            self._draw(low, high, trees, depth, rng)
            self._prune(counted(self))
            return
        self.feature, self.split, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        usable = np.flatnonzero(high > low)
        for _ in range(trees):
            rows = clean[rng.choice(len(clean), min(subsample, len(clean)), replace=False)]
            self.roots.append(self._grow(rows, low.copy(), high.copy(), 0, depth, usable, rng))
        self.arrays = tuple(np.array(x) for x in (self.feature, self.split, self.left, self.right, self.value, self.roots))
        self.depth = depth
        del self.feature, self.split, self.left, self.right, self.value, self.roots

    def _grow(self, rows, low, high, at, depth, usable, rng) -> int:
        me = len(self.feature)
        for x in (self.feature, self.split, self.left, self.right, self.value):
            x.append(0)
        n = len(rows)
        if n <= 1 or at >= depth or not len(usable):
            more = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
            self.feature[me], self.value[me] = -1, at + more
            return me
        f = int(rng.choice(usable))
        s = float(rng.uniform(low[f], high[f]))
        under = rows[:, f] < s
        self.feature[me], self.split[me] = f, s
        old, high[f] = high[f], s
        self.left[me] = self._grow(rows[under], low, high, at + 1, depth, usable, rng)
        high[f] = old
        old, low[f] = low[f], s
        self.right[me] = self._grow(rows[~under], low, high, at + 1, depth, usable, rng)
        low[f] = old
        return me

    def _draw(self, low: np.ndarray, high: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> None:
        """Trees of full depth; the children of a tree's node k are its nodes 2 k + 1 and 2 k + 2."""
        inner, size = 2**depth - 1, 2 ** (depth + 1) - 1
        usable = np.flatnonzero(high > low)
        feature, split = np.full((trees, size), -1), np.zeros((trees, size))
        for t in range(trees):
            boxes = [(low, high)]
            for k in range(inner if len(usable) else 0):
                a, z = boxes[k]
                f = int(rng.choice(usable))
                s = float(rng.uniform(a[f], z[f]))
                feature[t, k], split[t, k] = f, s
                under, over = z.copy(), a.copy()
                under[f] = over[f] = s
                boxes += [(a, under), (over, z)]
        at = np.arange(trees * size)
        left = at // size * size + np.where(at % size < inner, 2 * (at % size) + 1, 0)
        self.arrays = feature.ravel(), split.ravel(), left, left + 1, np.zeros(trees * size), np.arange(trees) * size
        self.depth = depth

    def _prune(self, counts: np.ndarray) -> None:
        """Counts of the leaves go up to the nodes above; where a row at most is, the path ends."""
        feature, split, left, right, value, roots = self.arrays
        n, size = counts.reshape(len(roots), -1).copy(), len(feature) // len(roots)
        for k in range(2**self.depth - 2, -1, -1):
            n[:, k] += n[:, 2 * k + 1] + n[:, 2 * k + 2]
        n = n.ravel()
        m = np.maximum(n, 3).astype(float)
        more = np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, n == 2)
        value[:] = np.floor(np.log2(np.arange(len(n)) % size + 1)) + more
        feature[n <= 1] = -1

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row, tree by tree."""
        feature, split, left, right, _, roots = self.arrays
        rows = np.arange(len(x))
        for root in roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = feature[node]
                if (f < 0).all():
                    break
                node = np.where(f < 0, node, np.where(x[rows, f] < split[node], left[node], right[node]))
            yield node

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row; short ones are anomalous."""
        value, roots = self.arrays[4:]
        total = np.zeros(len(x))
        for node in self.leaves(x):
            total += value[node]
        return total / max(len(roots), 1)


def calibrate(path: np.ndarray, quality: np.ndarray, cost: float, rows: np.ndarray | None = None) -> float:
    """The path length below which rows are rejected: most rejected caught, each clean share lost weighing ``cost``.

    ``rows`` tells how many rows have each path length and quality; one each without it.
    """
    bad, rows = quality == 0, np.ones(len(path)) if rows is None else rows
    if not bad.any() or bad.all():
        return -np.inf
    order = np.argsort(path, kind="stable")
    p, gain = path[order], np.cumsum((rows * np.where(bad, 1 / rows[bad].sum(), -cost / rows[~bad].sum()))[order])
    ends = np.flatnonzero(np.append(p[1:] > p[:-1], True))
    best = ends[np.argmax(gain[ends])]
    if gain[best] <= 0:
        return -np.inf
    return float((p[best] + p[min(best + 1, len(p) - 1)]) / 2)


def _ratios(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, x): identifier and ratios of each row."""
    out = fields(i=docs.schema[id_col].dataType, x=T.ArrayType(T.DoubleType()))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(statistics(texts(b.column(1)))[1].tolist(), pa.list_(pa.float64()))], names=out.names)

        return run

    return map_texts(docs.select(id_col, text_col), text_col, out, make)


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RATIOS))


def _length(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Path lengths in whole steps."""
    return np.round(forest.path(x) * STEPS).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, trees: int = 64, depth: int = 10, cost: float = 4.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """Forest and threshold from all labelled rows; None where they can't be had."""
    return _fit(_ratios(docs.where(F.col(id_col).isNotNull()), id_col, text_col), labels, trees, depth, cost, seed, id_col, label_col)


def _fit(ratios: DataFrame, labels: DataFrame, trees: int = 64, depth: int = 10, cost: float = 4.0, seed: int = 7, id_col: str = "doc_id", label_col: str = "quality"):
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("q"))
    # A row a labelled identifier, however often documents repeat it. No text is shuffled.
    rows = durable(ratios.join(chosen, "i").groupBy("i").agg(F.min("x").alias("x"), F.first("q").alias("q")).select("x", "q"))
    ends = [F.min(F.col("x")[k]) for k in range(len(RATIOS))] + [F.max(F.col("x")[k]) for k in range(len(RATIOS))]
    n, bad, *ends = rows.agg(F.count(F.lit(1)), F.count_if(F.col("q") == 0), *ends).first()
    if bad in (0, n):
        return None
    low, high = np.array(ends, dtype=float).reshape(2, -1)

    def counted(drawn: Forest) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(drawn.arrays[0]), dtype=np.int64)
            for b in batches:
                for node in drawn.leaves(_matrix(b.column(0))):
                    np.add.at(total, node, 1)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

        total = np.zeros(len(drawn.arrays[0]), dtype=np.int64)
        for r in rows.where("q <> 0").select("x").mapInArrow(run, fields(k=T.LongType(), n=T.LongType())).groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():  # a row a leaf at most
            total[r.k] = r.n
        return total

    forest = Forest(np.stack([low, high]), low, high, trees, 0, depth, seed, counted)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_length(forest, _matrix(b.column(0)))), b.column(1)], names=["p", "q"])

    found = rows.mapInArrow(lengths, fields(p=T.LongType(), q=T.IntegerType())).groupBy("p", (F.col("q") != 0).cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # two rows a length at most
    return forest, calibrate(found["p"].to_numpy() / STEPS, found["q"].to_numpy(), cost, found["n"].to_numpy())


def judge(base: np.ndarray, ratios: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each row."""
    failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
    return failed, ~failed if model is None else ~failed & (_length(model[0], ratios) / STEPS >= model[1])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row a document: base statistics, base_failed, kept, and the mean path length."""
    held = with_results(docs, id_col, fields(**dict.fromkeys(BASE, T.LongType()), x=T.ArrayType(T.DoubleType())))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            base, ratios = statistics(texts(b.column(1)))
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(ratios.tolist(), pa.list_(pa.float64()))], names=held.names)

        return run

    # Texts are read once; their statistics are kept for the fit and for the verdict.
    stats = durable(map_texts(docs.select(id_col, text_col), text_col, held, make))
    model = _fit(stats.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), "x"), labels, id_col=id_col, **fitting)
    out = with_results(docs, id_col, fields(**dict.fromkeys(BASE, T.LongType()), base_failed=T.BooleanType(), kept=T.BooleanType(), path_length=T.DoubleType()))

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, ratios = np.stack([c.to_numpy() for c in b.columns[1:-1]], axis=1), _matrix(b.column(len(BASE) + 1))
            failed, kept = judge(base, ratios, model)
            path = pa.nulls(len(base), pa.float64()) if model is None else pa.array(_length(model[0], ratios) / STEPS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(failed), pa.array(kept), path], names=out.names)

    return stats.mapInArrow(verdict, out)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The kept documents, all columns as they were; no shuffle of texts."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            base, ratios = statistics(texts(b.column(b.schema.get_field_index(text_col))))
            return b.filter(pa.array(judge(base, ratios, model)[1]))

        return run

    return map_texts(docs, text_col, docs.schema, make)
