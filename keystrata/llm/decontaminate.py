"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised items form one automaton; a document's words run through it while
the state and the longest matching length are tracked. A length of ``window`` or
more ends an occurrence of a window, and the state's ancestor at that length
knows the items. Items shorter than a window match whole. Only stretches of
words that items use at all enter the automaton.

The benchmark is cut into blocks of at most ``block_words`` words (some 70 MB as an
automaton), or one item. The driver builds and broadcasts them one by one; a task
holds HOLD bytes of rows and passes each block over them in turn, with one block
in memory at a time. The findings are joined within the row.

Null texts have no words; items without words match nothing; items with the same
identifier count once, items without one mark words only. Empty tables give
empty results or clean documents. Extra columns are ignored or passed through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fields, map_texts, texts, unused, with_results

#: Letters, digits and everything beyond ASCII stay; ASCII capitals become small, the rest parts words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


class Automaton:
    """States of all substrings of a block of items, with what each state ends."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seqs = []
        for name, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            seqs.append((name, ids))
            last = 0
            for c in ids:
                last = self._grow(last, c)
        self.least = min([window, *(len(ids) for _, ids in seqs)])
        n = len(self.len)
        order = sorted(range(1, n), key=self.len.__getitem__)
        # The ancestor whose strings include the one of the window's length.
        self.at_window = [-1] * n
        for s in order:
            if self.len[s] >= window:
                up = self.link[s]
                self.at_window[s] = self.at_window[up] if self.len[up] >= window else s
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str | None]]] = {}
        for name, ids in seqs:
            s = 0
            for k, c in enumerate(ids):
                s = self.next[s][c]
                # s holds the item's prefix; what ends here may sit in it or above it.
                if k + 1 >= window:
                    self.items.setdefault(self.at_window[s], set()).update([name] if name is not None else [])
            if len(ids) < window:
                short.setdefault(s, []).append((len(ids), name))
        # Short items that end in a state, from itself and its ancestors: (length, name).
        self.short: list[tuple] = [()] * n
        for s in order:
            own = tuple(short.get(s, ()))
            self.short[s] = own + self.short[self.link[s]] if self.link[s] > 0 else own

    def _grow(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, ids: list[int], at: int, marks: list[tuple[int, int]], items: set[str]) -> None:
        """Run known words that stand at ``at`` and on; append (first, end) of the occurrences."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        s = k = 0
        for i, c in enumerate(ids, at + 1):
            while s and c not in nxt[s]:
                s = link[s]
                k = length[s]
            if c in nxt[s]:
                s, k = nxt[s][c], k + 1
            if k >= window:
                marks.append((i - window, i))
                items |= self.items[self.at_window[s]]
            for m, name in self.short[s]:
                if m <= k:
                    marks.append((i - m, i))
                    if name is not None:
                        items.add(name)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences in a document as word ranges, and the items they belong to."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
        marks: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if z - a >= self.least:
                self.scan(ids[a:z].tolist(), a, marks, items)
        return marks, items


def union(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges with the same members."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def automata(benchmark: DataFrame, window: int, block_words: int, item_col: str, text_col: str) -> Iterator[Automaton]:
    """Automata of blocks of whole items; the driver holds one block at a time."""
    held, size = [], 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        words = normal_words(bytes(text or b""))
        if held and size + len(words) > block_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((name, words))
        size += len(words)
    if held:
        yield Automaton(held, window)


#: Bytes of text that a task passes one block after another over, where there is more than one.
HOLD = 32 << 20
FOUND = T.StructType([T.StructField("_marks", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))])


def _search(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The rows with two columns more, at the end: hit ranges (flat) and items."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(a) for a in automata(benchmark, window, block_words, item_col, item_text_col)]
    out = T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(unused(docs, "marks", "items"), FOUND))])

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = held[0].schema.get_field_index(text_col)
        words = [[normal_words(raw) for raw in texts(b.column(k))] for b in held] if len(blocks) == 1 else None
        marks, items = ([[[] for _ in range(b.num_rows)] for b in held] for _ in range(2))
        for block in blocks:
            automaton = block.value
            for b, its_marks, its_items, w in zip(held, marks, items, words or [None] * len(held)):
                for r, x in enumerate(w or (normal_words(raw) for raw in texts(b.column(k)))):
                    m, i = automaton.find(x)
                    if m:
                        old = its_marks[r]
                        its_marks[r] = [x for ab in union([*zip(old[::2], old[1::2]), *m]) for x in ab]
                        its_items[r] = sorted(i.union(its_items[r]))
            if len(blocks) > 1:
                del automaton
                block.__dict__.pop("_value", None)  # the next reading loads it from the worker's disk
        for b, m, i in zip(held, marks, items):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m, pa.list_(pa.int32())), pa.array(i, pa.list_(pa.string()))], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in chunks(batches, text_col):
            held.append(b)
            size += b.nbytes
            if len(blocks) < 2 or size >= HOLD:
                yield from found(held)
                held, size = [], 0
        if held:
            yield from found(held)

    return docs.mapInArrow(run, out)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = _search(docs.select(id_col, text_col), benchmark, window, block_words, text_col, item_col, item_text_col)
    out = with_results(docs, id_col, fields(n_words=T.LongType(), n_hit=T.LongType(), n_items=T.LongType(), items_sha256=T.StringType(), contaminated=T.BooleanType()))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            words = [len(normal_words(x)) for x in texts(b.column(1))]
            hit = [sum(m[1::2]) - sum(m[::2]) for m in b.column(2).to_pylist()]
            items = b.column(3).to_pylist()
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64(), size=len(items)), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([h > 0 for h in hit])], names=out.names)

        return run

    return map_texts(found, text_col, out, make)


def cut_spans(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges; white space around a cut becomes one space."""
    at = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    parts, done = [], 0
    for a, z in ranges:
        parts.append(raw[done : at[a][0]].rstrip())
        done = at[z - 1][1]
    parts.append(raw[done:].strip())
    return b" ".join(p for p in parts if p)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = 100_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents without the hit spans; those with more than ``max_coverage`` of their words hit go.

    Same columns as ``docs``; an ``n_chars`` column follows the text.
    """
    found = _search(docs, benchmark, window, block_words, text_col, item_col, item_text_col)
    out = docs.schema

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            marks = b.column(b.num_columns - 2).to_pylist()
            b = pa.RecordBatch.from_arrays(b.columns[:-2], names=out.names)
            if not any(marks):
                return b
            k = b.schema.get_field_index(text_col)
            cut, keep = b.column(k).to_pylist(), [True] * b.num_rows
            for r, m in enumerate(marks):
                if m:
                    raw = cut[r].encode()
                    keep[r] = sum(m[1::2]) - sum(m[::2]) <= max_coverage * len(normal_words(raw))
                    cut[r] = cut_spans(raw, list(zip(m[::2], m[1::2]))).decode()
            b = b.set_column(k, text_col, pa.array(cut, b.column(k).type))
            if "n_chars" in out.names:
                n = b.schema.get_field_index("n_chars")
                old = b.column(n).to_pylist()
                b = b.set_column(n, "n_chars", pa.array([len(cut[r]) if m else o for r, (m, o) in enumerate(zip(marks, old))], b.column(n).type))
            return b.filter(pa.array(keep))

        return run

    return map_texts(found, text_col, out, make)


_DOC = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_DOC} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_DOC} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM b)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
h AS (SELECT doc_id, i, m, item_id FROM dw JOIN iw USING (m, t)),
p AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
"""
