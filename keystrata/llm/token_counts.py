"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

The pre-tokens of a slice of texts lie end to end in one symbol array. In each
round every sequence finds the lowest rank among its adjacent pairs and applies
that pair wherever it stands, all sequences at once; sequences without a known
pair leave the array with their count. Counts agree with priority-queue BPE,
since a merged symbol only takes part in pairs of a higher rank.

Nulls and empty texts have no tokens. Very long texts go through in slices by
row; one pre-token is never cut. Repeated rows are counted each; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, map_texts, texts, with_results

#: The byte-level pre-token pattern. \s is spelt out: the library's has no U+001C to U+001F.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: In texts of ASCII and Latin letters alone, which is most, the standard library's faster matcher finds the same.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
ODD = rf"[^\x00-\x1b\x20-\x7f{_L}]"
PLAIN = rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Distinct pre-tokens whose counts a task remembers; beyond that it starts afresh.
MEMORY = 200_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + n)
    return table


class Merges:
    """Pair ranks as sorted arrays; a megabyte, whatever the corpus."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.start = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        _, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = keys[first], first.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word; words are not empty."""
        out = np.empty(len(words), dtype=np.int64)
        if not words:
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        last = np.zeros(len(sym), dtype=bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.full(len(sym), NONE, dtype=np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                out[seq[starts[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                sym, seq, last, rank = sym[keep], seq[keep], last[keep], rank[keep]
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # In a run such as "aaa" the pairs overlap: every second one counts, from the left.
            fresh = np.concatenate([[True], np.diff(at) != 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols stand after the gaps close
            sym, seq, last, rank = sym[keep], seq[keep], last[keep], rank[keep]
            changed = np.zeros(len(sym), dtype=bool)
            changed[moved] = True
            changed[moved[moved > 0] - 1] = True
            rank[changed] = NONE
            again = np.flatnonzero(changed & ~last)
            rank[again] = self.rank(sym[again], sym[again + 1])
        return out


class Counter:
    """Counts whole texts; remembers the counts of recent pre-tokens."""

    def __init__(self, merges: Merges) -> None:
        import regex

        self.any, self.plain, self.odd = regex.compile(PATTERN).findall, re.compile(PLAIN).findall, re.compile(ODD).search
        self.cut = regex.compile("|".join(regex.escape(s) for s in merges.special)).split if merges.special else lambda t: [t]
        self.merges, self.known = merges, {}

    def find(self, text: str) -> list[str]:
        return self.any(text) if self.odd(text) else self.plain(text)

    def __call__(self, raw: list[bytes]) -> list[int]:
        found, extra = [], []
        for b in raw:
            parts = self.cut(b.decode("utf-8", "replace"))
            extra.append(len(parts) - 1)
            found.append(self.find(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.find(p)])
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list(set().union(*found).difference(self.known)) if found else []
        self.known.update(zip(new, self.merges.count([w.encode() for w in new]).tolist()))
        get = self.known.__getitem__
        return [n + sum(map(get, f)) for n, f in zip(extra, found)]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: identifier, n_bytes, n_tokens, over_limit. Reads two columns; no shuffle."""
    merges = Merges(path)
    out = with_results(docs, id_col, fields(n_bytes=T.LongType(), n_tokens=T.LongType(), over_limit=T.BooleanType()))

    def make():
        count = Counter(merges)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = texts(b.column(1))
            n = count(raw)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64(), size=len(raw)), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=out.names)

        return run

    return map_texts(docs.select(id_col, text_col), text_col, out, make)
