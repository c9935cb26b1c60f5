"""Toxicity by a weighted finite-state grammar over clauses.

Transducers, composed into one (see ``compose``):

- lexical: a word to its class and weight: INSULT (learned words and word
  beginnings), THREAT, TARGET, NOT, SAYS (closed lists in four languages), a MARK
  that ends a clause, a STOP that ends a sentence, or another word;
- negation: an insult or threat up to NEAR_NOT words after NOT, in its clause, is
  denied;
- reported speech: what follows SAYS in its sentence is reported;
- aim: an insult or threat up to NEAR_TARGET words after TARGET, in its clause, is
  aimed. The same transducer runs over the clause from its end for targets after it.

An insult or threat so has a kind: aimed, plain, denied, reported, or menace (a
threat that is aimed; a threat that isn't counts for nothing). The grammar's
weight of the kind (``KIND_WEIGHT``) times the word's own is what the match adds to
its clause, and the clauses of a document are summed up. A word outside matched
clauses adds nothing. A logistic function of the sum's logarithm is the score.

Words, weights and the logistic function are learned from at most ``sample_rows``
labelled documents (documented bound, 24,000, by hash of the identifier) outside
the held-out fold; a labelled identifier with several texts counts with the
smallest. The weights of kinds are the grammar's own. Every document is scored
over its whole text. Labels, language, source and identifier are no inputs.

Null and empty texts have no evidence and get the score of that. Repeated rows
get the same score; ties of patterns go to the stronger, then by name; extra
columns are ignored. With no labelled row of one of the two classes the score is
that share of the other. Empty tables give none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_fold, fields, map_texts, shared_table, texts, with_results

TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?|\n]")
#: Lengths of word beginnings that may be patterns, and the least length of whole words.
STEMS, SHORTEST = range(5, 11), 4
#: A pattern's log-likelihood gain over the base rate, its log ratio of odds, and the documents it needs; chosen on a split within the training fold.
GAIN, ODDS, SUPPORT = 8.0, 2.5, 4
OTHER, INSULT, THREAT, TARGET, NOT, SAYS, MARK, STOP = range(8)
#: Flags that transducers put on an insult or threat.
DENIED, REPORTED, AIMED = 8, 16, 32
NEAR_NOT, NEAR_TARGET = 3, 6
_LISTS = {
    THREAT: "kill murder destroy hurt stab shoot strangle töten umbringen vernichten schlagen erschießen tuer frapper détruire étrangler matar destruir golpear apuñalar",
    TARGET: "you your yours yourself u ur he she they him them his their du dich dir dein deine ihr euch sie ihnen tu te toi vous votre vos ton ta tes ils elles usted ustedes tú ti vosotros ellos ellas",
    NOT: "not never no nor none without isn aren wasn don doesn nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun nunca jamás sin tampoco",
    SAYS: "said says say called calls wrote writes claimed claims reported quoted alleged sagte sagt nannte schrieb behauptete zitierte dit disait appelé écrit cité dijo dice llamó escribió citó",
    MARK: ", : |",
    STOP: ". ; ! ? \n",
}
CLOSED: dict[str, tuple[int, float]] = {w: (c, 1.0) for c, ws in _LISTS.items() for w in ws.split(" ")}
#: What a match weighs by its kind; a menace has no learned word and weighs as much as a strong one.
KINDS = ("aimed", "plain", "denied", "reported", "menace")
KIND_WEIGHT = np.array([1.5, 1.0, 0.1, 0.25, 6.0])

Arcs = dict[tuple[int, int], tuple[int, int]]


def _bases(flags: tuple[int, ...] = ()) -> list[int]:
    """Symbols of a tape: the classes, and insults and threats with each set of the flags."""
    out = list(range(8))
    for f in flags:
        out += [x | f for x in out if x & 7 in (INSULT, THREAT)]
    return out


def negation() -> Arcs:
    """State: for how many words a denial still reaches."""
    arcs = {}
    for s in range(NEAR_NOT + 1):
        for x in _bases():
            to = NEAR_NOT if x == NOT else 0 if x in (MARK, STOP) else max(s - 1, 0)
            arcs[s, x] = to, x | DENIED if s and x in (INSULT, THREAT) else x
    return arcs


def reported_speech() -> Arcs:
    """State: whether the sentence has a verb of saying."""
    arcs = {}
    for s in (0, 1):
        for x in _bases((DENIED,)):
            to = 0 if x == STOP else 1 if x == SAYS else s
            arcs[s, x] = to, x | REPORTED if s and x & 7 in (INSULT, THREAT) else x
    return arcs


def aim(flags: tuple[int, ...] = (DENIED, REPORTED)) -> Arcs:
    """State: for how many words a target still reaches."""
    arcs = {}
    for s in range(NEAR_TARGET + 1):
        for x in _bases(flags):
            to = NEAR_TARGET if x == TARGET else 0 if x in (MARK, STOP) else max(s - 1, 0)
            arcs[s, x] = to, x | AIMED if s and x & 7 in (INSULT, THREAT) else x
    return arcs


def compose(one: Arcs, two: Arcs) -> Arcs:
    """The transducer that gives what ``two`` makes of what ``one`` gives; states that can be reached from 0, numbered from there."""
    symbols = sorted({x for _, x in one})
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    for s, t in todo:
        for x in symbols:
            s2, y = one[s, x]
            t2, out = two[t, y]
            if (s2, t2) not in number:
                number[s2, t2] = len(number)
                todo.append((s2, t2))
            arcs[number[s, t], x] = number[s2, t2], out
    return arcs


GRAMMAR = compose(compose(negation(), reported_speech()), aim())
BACKWARD = aim((DENIED, REPORTED, AIMED))


def kind(symbol: int) -> int | None:
    """Index in KINDS of an insult or threat with its flags."""
    if symbol & REPORTED:
        return 3
    if symbol & DENIED:
        return 2
    if symbol & 7 == THREAT:
        return 4 if symbol & AIMED else None
    return 0 if symbol & AIMED else 1


def train_fold(id_col: str, mod: int, held: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod != held


class Lexicon:
    """The lexical transducer; remembers the words it has met."""

    MEMORY = 400_000

    def __init__(self, patterns: dict[str, float]) -> None:
        self.words = {p: w for p, w in patterns.items() if not p.endswith("*")}
        self.stems = {p[:-1]: w for p, w in patterns.items() if p.endswith("*")}
        self.known: dict[str, tuple[int, float]] = {}

    def find(self, word: str) -> tuple[int, float]:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n and (w := self.stems.get(word[:n], 0.0)) > best:
                best = w
        return (INSULT, best) if best > 0 else CLOSED.get(word, (OTHER, 0.0))

    def read(self, tokens: list[str]) -> list[tuple[int, float]]:
        known = self.known
        if len(known) > self.MEMORY:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = self.find(w)
        return [known[w] for w in tokens]


def evidence(lexicon: Lexicon, text: str) -> list[float]:
    """Summed weight of the matches of each kind, a menace as one."""
    found = [0.0] * len(KINDS)
    tape = lexicon.read(TOKEN.findall(text.lower()))
    if not any(c in (INSULT, THREAT) for c, _ in tape):
        return found
    state, marked = 0, []
    for c, _ in tape:
        state, y = GRAMMAR[state, c]
        marked.append(y)
    state = 0
    for k in range(len(marked) - 1, -1, -1):
        state, y = BACKWARD[state, marked[k]]
        if y & 7 in (INSULT, THREAT) and (j := kind(y)) is not None:
            found[j] += tape[k][1]
    return found


def design(x: np.ndarray) -> np.ndarray:
    """Logarithm of the weighted sum."""
    return np.log1p(x @ KIND_WEIGHT)


class Model:
    """Patterns, and the logistic function's two weights."""

    def __init__(self, patterns: dict[str, float], weights: np.ndarray) -> None:
        self.patterns, self.weights = patterns, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * design(x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Intercept and slope by Newton steps; the slope is not negative."""
    a = np.column_stack([np.ones(len(x)), design(x)])
    w, penalty = np.zeros(2), np.diag([1e-3, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-6)[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    if w[1] < 0:
        share = min(max(y.mean(), 1e-9), 1 - 1e-9)
        return np.array([np.log(share / (1 - share)), 0.0])
    return w


def _spread(rows: DataFrame, text_col: str, likely: dict[str, tuple[int, int]], bad: int, good: int) -> dict[str, float]:
    """Patterns that are strong even when their toxic documents count only as far as their contexts differ.

    Copies of a toxic document make all of its words look toxic. So a pattern's
    occurrences are counted by the words before and after it, and its toxic
    documents are taken to be no more than the effective number of contexts,
    (sum n)^2 / sum n^2, which copies hardly raise.
    """
    words, stems = {p for p in likely if not p.endswith("*")}, {p for p in likely if p.endswith("*")}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col):
            n: Counter = Counter()
            for raw, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                if y != 1:
                    continue
                tokens = ["", *TOKEN.findall(raw.decode("utf-8", "replace").lower()), ""]
                for before, w, after in zip(tokens, tokens[1:], tokens[2:]):
                    around = f"{before} {after}"
                    if w in words:
                        n[w, around] += 1
                    for k in STEMS:
                        if len(w) >= k and (p := w[:k] + "*") in stems:
                            n[p, around] += 1
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in keys], pa.string()), pa.array([a for _, a in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], names=["p", "around", "n"])

    seen = rows.mapInArrow(count, fields(p=T.StringType(), around=T.StringType(), n=T.LongType())).groupBy("p", F.xxhash64("around").alias("a")).agg(F.sum("n").alias("n"))
    spread = seen.groupBy("p").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("k"))
    found, rate = [], bad / (bad + good)
    for r in spread.collect():
        b, g = min(float(likely[r.p][0]), float(r.k)), likely[r.p][1]
        gain = b * np.log(b / ((b + g) * rate)) + (g * np.log(g / ((b + g) * (1 - rate))) if g else 0.0)
        odds = np.log((b + 0.5) / (bad + 1)) - np.log((g + 0.5) / (good + 1))
        if b >= SUPPORT and gain >= GAIN and odds >= ODDS:
            found.append((-gain, r.p, float(odds)))
    return {p: odds for _, p, odds in sorted(found)}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 24_000, mod: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Patterns and logistic weights from a bounded sample of the labelled documents outside the held-out fold."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train_fold(id_col, mod, held)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    chosen = usable.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    # A row a labelled identifier, however often documents repeat it; written once, read below.
    joined = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = shared_table(joined.select("text", "y"), "toxicity-sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({}, np.array([30.0 if bad else -30.0, 0.0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for raw, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                words = {w for w in TOKEN.findall(raw.decode("utf-8", "replace").lower()) if len(w) >= SHORTEST}
                n[y == 1].update(words)
                n[y == 1].update({w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
            keys = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], names=["p", "bad", "good"])

    sums = rows.mapInArrow(count, fields(p=T.StringType(), bad=T.LongType(), good=T.LongType())).groupBy("p").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    b, g = F.col("bad"), F.col("good")
    rate = bad / (bad + good)
    gain = b * F.log(b / ((b + g) * rate)) + F.when(g > 0, g * F.log(g / ((b + g) * (1 - rate)))).otherwise(0.0)
    odds = F.log((b + 0.5) / (bad + 1)) - F.log((g + 0.5) / (good + 1))
    strong = sums.where(b >= SUPPORT).withColumn("gain", gain).withColumn("odds", odds).where((F.col("gain") >= GAIN) & (F.col("odds") >= ODDS))
    patterns = _spread(rows, "text", {r.p: (int(r.bad), int(r.good)) for r in strong.collect()}, bad, good)

    seen = fields(x=T.ArrayType(T.DoubleType()), y=T.IntegerType())

    def make():
        lexicon = Lexicon(patterns)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([evidence(lexicon, x.decode("utf-8", "replace")) for x in texts(b.column(0))], pa.list_(pa.float64())), b.column(1)], names=seen.names)

        return run

    got = map_texts(rows, "text", seen, make).toPandas()  # sample_rows at most
    x = np.array(got["x"].tolist()).reshape(-1, len(KINDS))
    order = np.lexsort((*x.T, got["y"].to_numpy()))
    return Model(patterns, _logistic(x[order], got["y"].to_numpy()[order].astype(float)))


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row a document: held_out, score, predicted, and the evidence by kind of clause."""
    model = fit(docs, labels, mod=mod, held=held, id_col=id_col, text_col=text_col, **fitting)
    out = with_results(docs, id_col, fields(held_out=T.BooleanType(), score=T.DoubleType(), predicted=T.IntegerType(), **dict.fromkeys(KINDS, T.DoubleType())))

    def make():
        lexicon = Lexicon(model.patterns)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([evidence(lexicon, t.decode("utf-8", "replace")) for t in texts(b.column(1))]).reshape(-1, len(KINDS))
            s = model.score(x)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([f == held for f in crc_fold(b.column(0), mod)]), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *(pa.array(x[:, k]) for k in range(len(KINDS)))], names=out.names)

        return run

    return map_texts(docs.select(id_col, text_col), text_col, out, make)
