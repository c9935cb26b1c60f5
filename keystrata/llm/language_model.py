"""Language-model scores by a weighted backoff automaton over words, of order three.

P(w | h) = (c(h w) + m_n * P(w | h')) / (c(h) + m_n) for the contexts h of two
words and of one, where h' is h without its first word; P(w) takes a discount
off each seen word and gives what that frees to the one unseen word. Nothing of
this is tuned by hand: the discount is n1 / (n1 + 2 n2) of the words' counts of
counts, and m_n is such that the mass which contexts of n - 1 words give away on
the average is n1 / N of the n-grams, as Good and Turing have it.

As an automaton, a state is a context that occurs in training. It has an arc for
each word seen after it, which leads to the longest state that ends so, and a
failure arc of weight m_n / (c(h) + m_n) to the state without its first word; the
root has an arc for every word. One traversal from left to right carries the
state and adds up weights, which gives a text's log10 probability. Any number of
states is possible, since no task holds them all:

1. Documents are cut into pieces (slices of texts), written once.
2. A piece sends the hashes of its distinct n-grams, with their counts in
   training documents, to shards by hash range, packed in arrays. No piece sends
   more rows than it has n-grams, however many shards there are.
3. A shard adds up the counts of all pieces and answers each piece with the
   totals of what it asked for, in its order.
4. A piece's texts and answers meet; the piece builds its part of the automaton
   and walks its texts, in lanes that take a step at a time.

N-grams in half of a sample of the pieces or more (at most twice a piece's
n-grams, whatever the corpus) go no such way, as they would fill their shards with a row
from each piece: their counts are summed with map-side combine and sent to all.
The sample decides only which way an n-gram takes; all counts are of all
documents. N-grams are keyed by KEY_BITS of a hash.

Nulls and empty texts are one end token. Rows may repeat; each is learned and
scored. A null identifier counts as the empty text in the fold (so it is
trained on). Without training documents every text scores as the base does.
Very long texts are pieces of their own. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_fold, durable, fields, texts, with_results
from .hashing import WordHasher, mix

ORDER = 3
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Bits of a key: few enough for small messages, so many that of 10^13 n-grams one in some thousand meets another.
KEY_BITS = 56
#: How hard pieces are compressed: they are written and shuffled.
LEVEL = 12
#: Bytes of text in a piece.
PIECE_BYTES = 4 << 20
#: Bytes of text for each shard: its keys take about three times as many, so a shard stays small at any size of the corpus.
SHARD_BYTES = 16 << 20
#: Pieces that one task looks at for n-grams that half of all pieces have.
SAMPLE = 8
#: Tokens of a lane. A lane begins ORDER - 1 tokens earlier, by which any state is reached.
LANE = 256
#: Buckets of context counts, by the power of two.
BUCKETS = 48
#: The key of the end token.
ENDED = END >> np.uint64(64 - KEY_BITS)
PIECE = fields(body=T.BinaryType())
ROW = fields(shard=T.IntegerType(), piece=T.LongType(), n=T.IntegerType(), body=T.BinaryType(), counts=T.BinaryType())
#: stat, of a shard and order: n-gram tokens, distinct ones, those that occur once and twice, then context tokens by bucket.
ANSWER = fields(shard=T.IntegerType(), piece=T.LongType(), n=T.IntegerType(), body=T.BinaryType(), stat=T.ArrayType(T.LongType()))
STAT = 4 + BUCKETS


class Tokens:
    """The tokens of a piece, and its distinct n-grams by order with the index of each token's (the n-gram it ends).

    A context reaches back to BEGIN at most. Where it can't be as long, at a
    text's first token, the index of the trigram is -1.
    """

    def __init__(self, raw: list[bytes], hasher: WordHasher) -> None:
        words, sizes = hasher(raw)
        n = len(words) + len(raw)
        self.sizes = sizes + 1
        self.ends = np.cumsum(self.sizes) - 1 if len(raw) else np.zeros(0, dtype=np.int64)
        self.starts = self.ends - sizes
        hashes = np.empty(n, dtype=np.uint64)
        inner = np.ones(n, dtype=bool)
        inner[self.ends] = False
        hashes[inner], hashes[self.ends] = words, END
        first = np.zeros(n, dtype=bool)
        first[self.starts] = True
        before = np.empty(n, dtype=np.uint64)
        before[1:] = hashes[:-1]
        before[self.starts] = BEGIN
        step = np.uint64(0x9E3779B97F4A7C15)
        pair = mix(before * step + hashes)
        triple = mix(np.concatenate([pair[:1], pair[:-1]]) * step + (hashes ^ np.uint64(0x5851F42D4C957F2D)))
        self.keys, self.at = [], []
        for h, skip in ((hashes, None), (pair, None), (triple, first)):
            h = h >> np.uint64(64 - KEY_BITS)
            keys, at = np.unique(h if skip is None else h[~skip], return_inverse=True)
            if skip is not None:
                full = np.full(n, -1, dtype=np.int64)
                full[~skip] = at
                at = full
            self.keys.append(keys)
            self.at.append(at)
        self.first = first


def _squeeze(values: np.ndarray) -> bytes:
    """Integers by byte planes; equal bytes cost little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _loosen(body: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=0), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.uint64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, the upper bytes of which are mostly zero."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unpack(body: bytes) -> np.ndarray:
    return np.cumsum(_loosen(body), dtype=np.uint64)


def _pieces(docs: DataFrame, text_col: str) -> DataFrame:
    """(piece, body): slices of (identifier, text), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col, PIECE_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], names=PIECE.names)

    return durable(docs.mapInArrow(run, PIECE).select(F.monotonically_increasing_id().alias("piece"), "body"))


def _open(body: bytes) -> tuple[pa.Array, list[bytes]]:
    b = pa.ipc.open_stream(body).read_all().combine_chunks()
    return b.column(0).combine_chunks() if isinstance(b.column(0), pa.ChunkedArray) else b.column(0), texts(pa.concat_arrays(b.column(1).chunks) if b.num_rows else pa.array([], b.schema[1].type))


def _hot(pieces: DataFrame) -> list[np.ndarray]:
    """By order, sorted n-grams that half of a sample of the pieces have, and half of SAMPLE pieces at least."""
    some = [r[0] for r in pieces.select("piece").orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE).collect()]
    sample = pieces.where(F.col("piece").isin(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own, pieces = WordHasher(), [[] for _ in range(ORDER)], 0
        for b in batches:
            for body in b.column(1):
                pieces += 1
                for keys, held in zip(Tokens(_open(body.as_py())[1], hasher).keys, own):
                    held.append(keys)
        for n, held in enumerate(own, 1):
            keys, k = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0))
            keys = keys[2 * k >= max(pieces, SAMPLE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, dtype=np.int32)), pa.array(keys.view(np.int64))], names=["n", "h"])

    found = sample.coalesce(1).mapInArrow(run, fields(n=T.IntegerType(), h=T.LongType())).toPandas()
    return [np.sort(found["h"][found["n"] == n].to_numpy(dtype=np.int64).view(np.uint64)) for n in range(1, ORDER + 1)]


def _among(keys: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is a hot one, and where it stands among them."""
    if not len(hot):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return hot[at] == keys, at


def _training(ids: pa.Array, t: Tokens, mod: int, held: int) -> list[np.ndarray]:
    """By order, counts of the piece's n-grams in its training documents."""
    train = np.repeat(np.array(crc_fold(ids, mod)) != held, t.sizes)
    return [np.bincount(at[train & (at >= 0)], minlength=len(keys)) for keys, at in zip(t.keys, t.at)]


def _hot_counts(pieces: DataFrame, hot: list[np.ndarray], mod: int, held: int) -> list[np.ndarray]:
    """By order, counts of the hot n-grams in all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sums = WordHasher(), [np.zeros(len(h), dtype=np.int64) for h in hot]
        for b in batches:
            for body in b.column(1):
                ids, raw = _open(body.as_py())
                t = Tokens(raw, hasher)
                for keys, counts, h, total in zip(t.keys, _training(ids, t, mod, held), hot, sums):
                    is_hot, at = _among(keys, h)
                    total[at[is_hot]] += counts[is_hot]
        for n, total in enumerate(sums, 1):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["n", "k", "c"])

    out = [np.zeros(len(h), dtype=np.int64) for h in hot]
    if any(len(h) for h in hot):
        for r in pieces.mapInArrow(run, fields(n=T.IntegerType(), k=T.IntegerType(), c=T.LongType())).groupBy("n", "k").agg(F.sum("c").alias("c")).toLocalIterator():
            out[r.n - 1][r.k] = r.c
    return out


def _asks(pieces: DataFrame, hot: list[np.ndarray], bits: int, mod: int, held: int) -> DataFrame:
    """Rows for the shards: a piece's keys with the shard's leading bits, and their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for piece, body in zip(b.column(0).to_pylist(), b.column(1)):
                ids, raw = _open(body.as_py())
                t = Tokens(raw, hasher)
                rows: list[tuple] = []
                for n, (keys, counts, h) in enumerate(zip(t.keys, _training(ids, t, mod, held), hot), 1):
                    cold = ~_among(keys, h)[0]
                    keys, counts = keys[cold], counts[cold]
                    shard = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
                    cut = np.flatnonzero(np.diff(shard, prepend=-1, append=1 << bits))
                    rows += [(int(shard[a]), piece, n, _pack(keys[a:z]), _squeeze(counts[a:z])) for a, z in zip(cut.tolist(), cut[1:].tolist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=ROW.names)

    return pieces.mapInArrow(run, ROW)


def _statistics(keys: np.ndarray, total: np.ndarray, n: int) -> list[int]:
    """What the model needs of some n-grams' counts."""
    seen = total[total > 0]
    buckets = np.zeros(BUCKETS, dtype=np.int64)
    context = total[(total > 0) & (keys != ENDED)] if n == 1 else seen  # nothing follows an end
    np.add.at(buckets, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), context)
    return [int(seen.sum()), len(seen), int((seen == 1).sum()), int((seen == 2).sum()), *buckets.tolist()]


def _answers(asks: DataFrame) -> DataFrame:
    """A shard's totals for each piece, in the order of its keys; and the shard's statistics."""

    def run(group: pa.Table) -> pa.Table:
        shard, rows = group["shard"][0].as_py(), []
        for n in range(1, ORDER + 1):
            own = group.filter(pc.equal(group["n"], n))
            if not own.num_rows:
                continue
            keys = [_unpack(x.as_py()) for x in own["body"]]
            counts = np.concatenate([_loosen(x.as_py()) for x in own["counts"]]).astype(np.int64)
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
            at = 0
            for piece, k in zip(own["piece"].to_pylist(), keys):
                rows.append((shard, piece, n, _squeeze(total[inverse[at : at + len(k)]]), None))
                at += len(k)
            rows.append((shard, -1, n, None, _statistics(distinct, total, n)))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=ANSWER.names)

    return asks.groupBy("shard").applyInArrow(run, ANSWER)


class Smoothing:
    """Tokens N, distinct words V, documents, the discount, and the mass m of each order, from statistics by order."""

    def __init__(self, stats: list[list[int]], begun: int) -> None:
        self.total, self.distinct, once, twice = stats[0][:4]
        self.begun = begun
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.mass = [0.0]
        for n in range(2, ORDER + 1):
            tokens, _, once, _ = stats[n - 1][:4]
            contexts = np.array(stats[n - 2][4:], dtype=np.float64)
            size = 1.5 * 2.0 ** np.arange(BUCKETS)  # the middle of a bucket
            size[0] = 1.0
            if n == 2 and begun:
                contexts[min(int(np.log2(begun)), BUCKETS - 1)] += begun
            self.mass.append(self._mass(contexts, size, min(max(once / max(tokens, 1), 1e-3), 0.999)))

    @staticmethod
    def _mass(contexts: np.ndarray, size: np.ndarray, given: float) -> float:
        """m for which contexts give away the share ``given`` on the average, m / (c + m) weighted by c."""
        if not contexts.sum():
            return 1.0
        low, high = 1e-3, 1e9
        for _ in range(100):
            m = (low * high) ** 0.5
            low, high = (m, high) if (contexts * m / (size + m)).sum() < given * contexts.sum() else (low, m)
        return m


class BackoffAutomaton:
    """The part of the automaton that a piece touches.

    States: 0 the root, then a text's beginning, the known words, the known pairs
    of words. ``arc_key`` (state * words + word, sorted) has the arcs with their
    weights and where they lead; ``fail`` and ``fail_weight`` the failure arcs.
    Words are the piece's; the root's arcs are ``root_weight`` and ``root_to``.
    """

    def __init__(self, t: Tokens, counts: list[np.ndarray], smoothing: Smoothing) -> None:
        words, pairs, triples = counts
        total, distinct, discount = smoothing.total, smoothing.distinct, smoothing.discount
        _, m2, m3 = smoothing.mass
        word, pair, triple = t.at
        v = len(words)
        chance = np.where(words > 0, words - discount, discount * distinct) / total
        is_context = (words > 0) & (t.keys[0] != ENDED)
        self.words = v
        word_state = np.where(is_context, 2 + np.cumsum(is_context) - 1, 0)
        at = 2 + int(is_context.sum())
        # One token of each distinct pair and triple tells its words.
        some_pair = np.zeros(len(pairs), dtype=np.int64)
        some_pair[pair] = np.arange(len(pair))
        before = np.where(t.first[some_pair], -1, word[np.maximum(some_pair - 1, 0)])
        last = word[some_pair]
        holds = (pairs > 0) & is_context[last] if len(pairs) else np.zeros(0, dtype=bool)
        pair_state = np.where(holds, at + np.cumsum(holds) - 1, word_state[last]) if len(pairs) else np.zeros(0, dtype=np.int64)
        states = at + int(holds.sum())
        self.root_weight, self.root_to = np.log10(chance), word_state
        self.fail = np.zeros(states, dtype=np.int64)
        self.fail_weight = np.zeros(states)
        self.fail_weight[1] = np.log10(m2 / (smoothing.begun + m2)) if smoothing.begun else 0.0
        self.fail_weight[2:at] = np.log10(m2 / (words[is_context] + m2))
        self.fail[at:] = word_state[last[holds]]
        self.fail_weight[at:] = np.log10(m3 / (pairs[holds] + m3))
        # Arcs from one-word states: the pairs that training has.
        seen = np.flatnonzero(pairs > 0)
        context = np.where(before[seen] < 0, smoothing.begun, words[np.maximum(before[seen], 0)])
        origin = np.where(before[seen] < 0, 1, word_state[np.maximum(before[seen], 0)])
        second = np.zeros(len(pairs))
        second[seen] = (pairs[seen] + m2 * chance[last[seen]]) / (context + m2)
        # Arcs from two-word states: the triples. The triple's tail is a pair that training has too.
        some = np.zeros(len(triples), dtype=np.int64)
        real = np.flatnonzero(triple >= 0)
        some[triple[real]] = real
        some = some[triples > 0]
        head, tail = pair[some - 1], pair[some]
        third = (triples[triples > 0] + m3 * second[tail]) / (pairs[head] + m3)
        key = np.concatenate([origin * v + last[seen], pair_state[head] * v + word[some]])
        to = np.concatenate([pair_state[seen], pair_state[tail]])
        weight = np.log10(np.concatenate([second[seen], third]))
        order = np.argsort(key)
        self.arc_key, self.arc_to, self.arc_weight = key[order], to[order], weight[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and weights after each lane's word: failure arcs until a state has an arc for it."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        open_ = np.arange(len(state))
        at = state
        while len(open_):
            w = word[open_]
            key = at * self.words + w
            k = np.minimum(np.searchsorted(self.arc_key, key), max(len(self.arc_key) - 1, 0))
            has = self.arc_key[k] == key if len(self.arc_key) else np.zeros(len(key), dtype=bool)
            root = ~has & (at == 0)
            done = open_[has]
            weight[done] += self.arc_weight[k[has]]
            to[done] = self.arc_to[k[has]]
            done = open_[root]
            weight[done] += self.root_weight[w[root]]
            to[done] = self.root_to[w[root]]
            on = ~has & ~root
            open_, at = open_[on], at[on]
            weight[open_] += self.fail_weight[at]
            at = self.fail[at]
        return to, weight

    def walk(self, t: Tokens) -> np.ndarray:
        """Log10 weight of every token: all lanes go on by a token at a time and carry their states.

        A text is one lane, or several if it is long; a lane in the middle takes
        up its state on the two tokens before it, which settle it.
        """
        word = t.at[0]
        lead = ORDER - 1
        starts, stops, warm = [], [], []
        for a, n in zip(t.starts.tolist(), t.sizes.tolist()):
            cuts = [*range(a, a + n, LANE), a + n]
            starts += [c if c == a else c - lead for c in cuts[:-1]]
            warm += [0 if c == a else lead for c in cuts[:-1]]
            stops += cuts[1:]
        start, stop, skip = np.array(starts), np.array(stops), np.array(warm)
        order = np.argsort(start - stop, kind="stable")  # longest lanes first, so that live lanes are a prefix
        start, stop, skip = start[order], stop[order], skip[order]
        size = stop - start
        out = np.zeros(len(word))
        # A lane that begins within a text begins at the root and knows its context after the lead.
        state = np.where(skip == 0, 1, 0)
        for k in range(int(size.max()) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, side="left"))
            state, weight = self.step(state[:live], word[start[:live] + k])
            counts = skip[:live] <= k
            out[start[:live][counts] + k] = weight[counts]
        return out


def lm_scores(docs: DataFrame, mod: int = 7, held: int = 2, shard_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    pieces = _pieces(docs.select(id_col, text_col), text_col)
    if shard_bits is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        shard_bits = min(30, max(3, int(-(-size // SHARD_BYTES) - 1).bit_length()))
    hot = _hot(pieces)
    known = _hot_counts(pieces, hot, mod, held)
    answers = durable(_answers(_asks(pieces, hot, shard_bits, mod, held)))
    stats = [np.array(_statistics(h, c, n), dtype=object) for n, (h, c) in enumerate(zip(hot, known), 1)]
    for r in answers.where("piece < 0").groupBy("n").agg(*[F.sum(F.col("stat")[k]).alias(f"s{k}") for k in range(STAT)]).collect():
        stats[r.n - 1] = stats[r.n - 1] + np.array(r[1:], dtype=object)
    # As many texts end as begin; an end is in nearly every piece, or its shard knows.
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod != held
    smoothing = Smoothing([list(map(int, s)) for s in stats], docs.where(fold).count())
    out = with_results(docs, id_col, fields(held_out=T.BooleanType(), n_tokens=T.LongType(), n_known=T.LongType(), train_tokens=T.LongType(), base_score=T.DoubleType(), score=T.DoubleType()))
    both = answers.where("piece >= 0").select("piece", "n", "shard", "body").unionByName(pieces.select("piece", F.lit(0).alias("n"), F.lit(0).alias("shard"), "body"))
    return both.groupBy("piece").applyInArrow(_scorer(smoothing, hot, known, mod, held, out), out)


def _scorer(smoothing: Smoothing, hot: list[np.ndarray], known: list[np.ndarray], mod: int, held: int, out: T.StructType) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["n"].to_pylist(), group["shard"].to_pylist(), group["body"]), key=lambda r: r[:2])
        ids, raw = _open(rows[0][2].as_py())
        t, counts = Tokens(raw, WordHasher()), []
        for n, (keys, h, c) in enumerate(zip(t.keys, hot, known), 1):
            is_hot, at = _among(keys, h)
            total = np.zeros(len(keys), dtype=np.int64)
            total[is_hot] = c[at[is_hot]] if len(h) else 0
            told = [_loosen(body.as_py()) for k, _, body in rows if k == n]
            total[~is_hot] = np.concatenate(told).astype(np.int64) if told else 0
            counts.append(total)
        words = counts[0]
        base = np.log10((words + 1) / (smoothing.total + smoothing.distinct + 1))[t.at[0]]
        step = BackoffAutomaton(t, counts, smoothing).walk(t) if smoothing.total else base
        known_words = (words > 0)[t.at[0]]
        add = lambda x: np.add.reduceat(x, t.starts)
        return pa.table([ids, pa.array(np.array(crc_fold(ids, mod)) == held), pa.array(t.sizes.astype(np.int64)), pa.array(add(known_words.astype(np.int64))), pa.array(np.full(len(t.sizes), smoothing.total, dtype=np.int64)), pa.array(add(base)), pa.array(add(step))], names=out.names)

    return run
