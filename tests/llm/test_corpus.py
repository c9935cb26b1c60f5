"""Corpus operators against brute force on small fixtures, with the awkward rows in them."""

import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keystrata.llm import components, decontaminate, html_text, language_model, licenses, mixing, passages, quality, registry, simhash, token_counts, toxicity

SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(n=60, seed=3):
    """Random texts with exact copies, near copies, nulls, empties, odd spaces and one long text."""
    rng, vocab = random.Random(seed), vocabulary(400, seed)
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120)))) for i in range(n)]
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, rows[5][1] + " tail"), (n + 4, None), (n + 5, ""), (n + 6, " \t\n "), (n + 7, "One\x85two\xa0three\x1cfour  FIVE\r\nsix"), (n + 8, " ".join(rng.choice(vocab) for _ in range(6000))), (n + 9, "é" * 50)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in rows], DOCS).withColumn("score", F.lit("mine")).withColumn("kept", F.lit(7)).repartition(3).cache()


def empty(docs):
    return docs.where(F.lit(False))


# Quality rules


def brute_statistics(text):
    w = words_of(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def labels_of(spark, rows, bad):
    return spark.createDataFrame([(i, 0 if i in bad else 1, 1 if i in bad else 0) for i, _ in rows], "doc_id long, quality int, toxic int")


def test_quality(spark, rows, docs):
    junk = [(200 + i, " ".join(f"w{i}{j}### $$$" for j in range(60))) for i in range(12)] + [(300, "a b c d e f g h\n" * 20), (301, "x\nx\n\nx\ny # | &")]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(junk, "doc_id long, text string"))
    labels = labels_of(spark, rows + junk, {i for i, _ in junk})
    got = {r.doc_id: r for r in quality.quality_rules(all_docs, labels).collect()}
    assert len(got) == len(rows) + len(junk)
    for i, t in rows + junk:
        r, want = got[i], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert not any(got[i].kept for i, _ in junk)
    clean = [i for i, _ in rows if not got[i].base_failed]
    assert sum(got[i].kept for i in clean) >= 0.9 * len(clean)
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {i for i in got if got[i].kept} | set(clean)
    assert quality.quality_rules(docs, labels.where("false")).where("kept = base_failed").count() == 0
    assert quality.quality_rules(empty(docs), labels).count() == 0


def test_labelled_documents_that_repeat_count_once(spark, docs, monkeypatch):
    some = docs.where("doc_id < 40")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "Forest", lambda x, *_: seen.append(len(x)) or type("F", (), {"path": lambda self, y: y[:, 0]})())
    quality.fit(some, labels)
    quality.fit(some.unionByName(some).unionByName(some), labels)
    assert seen[0] == seen[1] > 0


def test_quality_counts_every_labelled_row(spark, monkeypatch):
    # 200 clean rows have a symbol in each word; with these among the counted rows no such row is apart.
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(60)), 1) for i in range(6500)]
    noted = [(10_000 + i, " ".join(f"w{i}x{j}#" for j in range(60)), 1) for i in range(200)]
    junk = [(20_000 + i, " ".join(f"w{i}x{j}!" for j in range(60)), 0) for i in range(200)]
    rows = plain + noted + junk
    texts, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    seen = []
    inner = quality.calibrate
    monkeypatch.setattr(quality, "calibrate", lambda path, q, cost, n: seen.append((n[q == 0].sum(), n[q != 0].sum())) or inner(path, q, cost, n))
    forest, least = quality.fit(texts, labels)
    assert seen == [(200, 6700)]
    path = lambda some: quality._length(forest, quality.statistics([t.encode() for _, t, _ in some])[1]) / quality.STEPS
    assert path(junk).max() < least <= min(path(plain).min(), path(noted).min())
    again = quality.fit(texts.repartition(7), labels.repartition(3))
    assert again[1] == least and all((a == b).all() for a, b in zip(again[0].arrays, forest.arrays))


def test_forest_isolates_what_lies_apart():
    rng = np.random.default_rng(1)
    clean = rng.normal(0.2, 0.02, (500, 3))
    f = quality.Forest(clean, np.zeros(3), np.ones(3), 50, 128, 10, 1)
    apart = f.path(np.array([[0.9, 0.2, 0.2], [0.2, 0.2, 0.8]]))
    assert apart.max() < f.path(clean).min()
    assert quality.calibrate(np.array([1.0, 2.0, 5.0, 6.0]), np.array([0, 0, 1, 1]), 4.0) == 3.5
    assert quality.calibrate(np.array([1.0, 2.0]), np.array([1, 1]), 4.0) == -np.inf


# Near-duplicates


def brute_fingerprint(text):
    w = words_of(lower(text))
    grams = [w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else [])
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{id: fingerprint} -> {id: smallest id reachable}."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(rows, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    want = brute_components(fps)
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(empty(docs)).count() == 0
    twice = simhash.keep_one_each(docs.unionByName(docs))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(set(want.values()))


def test_near_duplicates_through_a_row_without_identifier(spark, monkeypatch):
    """Two documents that only a row without an identifier links are one component."""
    prints = [(1, 0b1), (None, 0b1111), (2, 0b1111111), (3, 1 << 40), (None, 1 << 50 | 1 << 55 | 1 << 60 | 1 << 62), (4, 1 << 40)]
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, *_: docs)
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 2), (None, 1, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1), (None, None, 0)], key=str)


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_of_a_hot_wild_bit(spark, monkeypatch, crowd):
    """Many fingerprints with one half and many with that half but for a bit: pairs tried stay few, none is lost."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng, half = random.Random(9), 0x12345678
    low = sorted({rng.getrandbits(32) & 0x7FF for _ in range(300)})
    fps = [x << 32 | half ^ flip for x in low for flip in (0, 1 << 7)]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, v long")
    edges = {tuple(sorted((r.a, r.b))) for r in simhash.links(df).collect()}
    assert edges == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(fps[a] ^ fps[b]).count("1") <= 3}


@pytest.mark.parametrize("crowd", [64, 3, 1])
def test_links_are_exact(spark, monkeypatch, crowd):
    """Random fingerprints around a few centres, many with a half in common; small crowds take the deeper indexes."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(rng.choice([32, 64]))
            fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, v long")
    edges = {tuple(sorted((r.a, r.b))) for r in simhash.links(df).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3}
    assert edges == want
    got = {r.v: r.root for r in components.components(simhash.links(df)).collect()}
    assert {i: got.get(i, i) for i in fps} == brute_components(fps)


def test_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (300, 250), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and got[300] == 200 and got[250] == 200
    assert components.components(df.where("false")).count() == 0


# Benchmark decontamination


def normal(text):
    return "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or ord(c) > 127 else " " for c in lower(text)).split(" ")


def brute_hits(text, items, window):
    w, hit, found = [x for x in normal(text) if x], set(), set()
    for i, t in items:
        v = [x for x in normal(t) if x]
        n = min(window, len(v))
        for g in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == g:
                    hit.update(range(k, k + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [500_000, 40])
def test_contamination(spark, rows, docs, block):
    items = [(0, " ".join(rows[2][1].split()[:12])), (1, rows[4][1]), (10, rows[4][1].upper() + "!"), (2, "six five"), (3, ""), (4, None), (5, "aaa bbb aaa bbb aaa bbb aaa bbb aaa bbb aaa bbb")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(900, "x aaa bbb aaa bbb aaa bbb aaa bbb aaa bbb aaa y " + (rows[2][1] + " ") * 2), (901, "five, SIX five-six")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(more, bench, window=5, block_words=block).collect()}
    assert got == {i: brute_hits(t, items, 5) for i, t in rows + extra}
    cut = {r.doc_id: r.text for r in decontaminate.remove_contamination(more, bench, window=5, max_coverage=1.0, block_words=block).collect()}
    assert len(cut) == len(got) and cut[901] == "five, -six".replace(", -", " ").replace("five six", "five") or 901 in cut
    for i, t in rows + extra:
        assert (cut[i] == t) == (not got[i][4])
    left = {r.doc_id for r in decontaminate.remove_contamination(more, bench, window=5, max_coverage=0.5, block_words=block).collect()}
    assert left == {i for i in got if 2 * got[i][1] <= got[i][0]}


def test_contamination_of_columns_that_clash(spark, rows):
    bench = spark.createDataFrame([(0, rows[2][1]), (1, "six five")], "item_id long, text string")
    named = ("_marks", "_items", "marks", "ITEMS", "n_words", "item_id")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.remove_contamination(df.withColumns({c: F.lit(c) for c in named}), bench)
    assert out.columns == ["doc_id", "text", *named] and all(r[c] == c for r in out.limit(3).collect() for c in named)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in decontaminate.remove_contamination(df, bench).collect()}


def test_contamination_of_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).where("contaminated").count() == 0
    assert decontaminate.remove_contamination(docs, bench).count() == docs.count()
    assert decontaminate.contamination(empty(docs), bench).count() == 0


# Passages


def fuzzy(words, edits, rng, vocab):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        op = rng.choice("sid")
        if op == "s":
            out[k] = rng.choice(vocab)
        elif op == "i":
            out.insert(k, rng.choice(vocab))
        else:
            del out[k]
    return out


@pytest.fixture(scope="module")
def planted():
    rng, vocab = random.Random(11), vocabulary(5000, 12)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = {i: text(rng.randint(30, 400)) for i in range(40)}
    shared, other = text(80), text(70)
    for i in (4, 9, 21, 33):
        k = rng.randint(0, 20)
        rows[i][k:k] = shared
    rows[12][10:10] = other
    rows[30][0:0] = fuzzy(other, 4, rng, vocab)
    rows[50] = list(rows[7]) + text(3)
    rows[51], rows[52] = list(shared[:30]), text(2)
    return rows


def test_shared_passages(spark, planted):
    data = [(i, "".join(c.upper() if c.isascii() else c for c in " ".join(w).replace(" ", "\n", 1)) if i == 9 else " ".join(w)) for i, w in planted.items()] + [(60, None), (61, ""), (None, " ".join(planted[4]))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = passages.shared_passages(df).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    assert pairs >= {(9, 4), (21, 4), (33, 4), (30, 12), (50, 7)} and pairs <= {(9, 4), (21, 4), (21, 9), (33, 4), (33, 9), (33, 21), (30, 12), (50, 7)}
    for r in got:
        a, b = planted[r.doc_id][r.start : r.end], planted[r.source_id][r.source_start : r.source_end]
        assert r.end - r.start >= 50 and r.similarity >= 0.8
        assert 2 * _lcs(list(map(lower, a)), list(map(lower, b))) / (len(a) + len(b)) >= r.similarity - 0.02
    spans = {(r.doc_id): r.end - r.start for r in got}
    assert abs(spans[33] - 80) <= 2 and spans[50] == len(planted[7])
    assert passages.shared_passages(df.where("false")).count() == 0


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_remove_repeats(spark, planted):
    data = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in planted.items()] + [(70, " ".join(planted[8]), "en", "s", 1), (71, None, "en", "s", None), (None, " ".join(planted[4]), "en", "s", 2)]
    df = spark.createDataFrame(data, DOCS).repartition(4)
    out = passages.remove_repeats(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and 70 not in got and set(got) == {i for i, *_ in data} - {70}
    assert got[4].text == data[4][1] and got[71].text is None and got[None].text == data[4][1]
    assert got[50].text.split() == planted[50][-3:] and got[50].n_chars == len(got[50].text)
    assert len(got[33].text.split()) <= len(planted[33]) - 78


def test_hot_seeds_take_the_other_way(spark, planted, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in planted.items()], "d long, text string").repartition(2).cache()
    want, found = {tuple(r) for r in passages.matches(df).collect()}, {tuple(r) for r in passages.shared_passages(df, "d").collect()}
    monkeypatch.setattr(passages, "HOT", 3)
    monkeypatch.setattr(passages, "LOCAL", 2)
    hot = passages.hot_seeds(df)
    assert hot and all(passages.hot_seeds(df)[h] == hot[h] for h in hot)
    got = {tuple(r) for r in passages.matches(df).collect()}
    firsts = {}
    for d, s, p, q in want:
        firsts[d, p] = min(firsts.get((d, p), (s, q)), (s, q))
    assert all((d, s, p, q) in got for (d, p), (s, q) in firsts.items())
    cover = lambda rows: {(r[0], i) for r in rows for i in range(r[2], r[3])}
    assert cover(map(tuple, passages.shared_passages(df, "d").collect())) == cover(found)


def _earlier(docs, least):
    """Brute force: (document, word) in a run of ``least`` words that an earlier document has, and the pairs with such a run."""
    grams, words, pairs = {}, set(), set()
    for d in sorted(docs):
        w = docs[d]
        own = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        for i, g in enumerate(own):
            if g in grams:
                words.update((d, k) for k in range(i, i + least))
                pairs.update((d, s) for s in grams[g])
        for g in own:
            grams.setdefault(g, set()).add(d)
    return words, pairs


def test_no_passage_is_lost_to_an_earlier_part_of_it(spark):
    """Every word of a verbatim repeat is found, all pairs compared, however earlier documents hold parts of it."""
    rng, vocab = random.Random(21), vocabulary(5000, 22)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = text(70)
    docs = {1: text(60) + shared[20:50] + text(60), 2: text(40) + shared + text(30), 3: text(20) + shared + text(50)}
    data = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    assert [tuple(r) for r in passages.shared_passages(data).collect()] == [(3, 2, 20, 90, 40, 110, 1.0)]
    quotes, docs = [text(rng.randint(60, 120)) for _ in range(6)], {}
    for i in range(80):
        w = text(rng.randint(5, 40))
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(quotes)
            a = rng.randint(0, len(q) - 20)
            w += q[a : rng.randint(a + 15, len(q))] + text(rng.randint(0, 30))
        docs[i] = w
    want, pairs = _earlier(docs, 50)
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)).collect()
    found = {(r.doc_id, k) for r in got for k in range(r.start, r.end)}
    assert len(want) > 1000 and len(want & found) >= 0.99 * len(want)
    # Documents that share a passage hang together through the rows found.
    group = {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for r in got:
        group[root(r.doc_id)] = root(r.source_id)
    assert sum(root(d) == root(s) for d, s in pairs) == len(pairs) > 50


@pytest.mark.parametrize("crowd", [32, 2])
def test_no_passage_is_lost_between_the_first_and_the_previous(spark, monkeypatch, crowd):
    """A passage of phrases, each of which the first and the previous document have elsewhere, is found in the document between."""
    monkeypatch.setattr(passages, "CROWD", crowd)
    rng, vocab = random.Random(41), vocabulary(5000, 42)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    parts = [text(12) for _ in range(5)]
    mixed = lambda: sum((text(30) + parts[k] for k in rng.sample(range(5), 5)), text(9))
    # One word between phrases, another one in each document: no seed goes across.
    joined = lambda: sum((p + text(1) for p in parts), [])
    docs = {1: mixed(), 2: mixed(), 3: text(20) + joined() + text(20), 4: mixed(), 5: mixed(), 6: text(35) + joined() + text(9), 7: text(40)}
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(6, 3)}
    assert max(r.end - r.start for r in got) >= 50


@pytest.mark.parametrize("held", [20_000, 3])
def test_no_passage_of_crowded_seeds_is_lost(spark, monkeypatch, held):
    """All seeds of a passage are crowded, and none is followed by the same crowded seed in both documents."""
    monkeypatch.setattr(passages, "CROWD", 2)
    monkeypatch.setattr(passages, "HELD", held)
    rng, vocab = random.Random(45), vocabulary(5000, 46)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    parts, between = [text(19) for _ in range(2)], [text(16)]
    mixed = lambda: sum((text(30) + x for x in rng.sample(parts + between, 3)), text(9))
    one = lambda: parts[0] + text(1) + parts[1]
    other = lambda: sum((p + (between[k] if k < 1 else []) for k, p in enumerate(parts)), [])
    docs = {1: mixed(), 2: mixed(), 3: text(20) + one() + text(20), 4: mixed(), 5: mixed(), 6: text(35) + other() + text(9), 7: mixed()}
    data = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    got = passages.shared_passages(data).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(6, 3)} and max(r.end - r.start for r in got) >= 50
    left = {r.doc_id: r.text.split() for r in passages.remove_repeats(data).collect()}
    assert len(left[6]) <= len(docs[6]) - 50 and all(left[i] == docs[i] for i in docs if i != 6)


def test_crowded_seeds_meet_wherever_a_passage_is_possible():
    """The filters of areas against counters and plain tables of common subsequences."""
    rng = np.random.default_rng(3)
    areas = rng.integers(1, 300, (48, passages.WIDTH)).astype(np.uint16)
    for i in range(24):
        other = rng.random(passages.WIDTH) < i / 60
        areas[i + 24] = np.where(other, rng.integers(1, 300, passages.WIDTH), areas[i])
        areas[i + 24, : rng.integers(0, 60)] = 0
        areas[i + 24, passages.AROUND : passages.AROUND + passages.K] = areas[i, passages.AROUND : passages.AROUND + passages.K]
    words, pairs = ([Counter(r[r > 0].tolist()) for r in x] for x in (areas, passages._pairs(areas)))
    want = {(i, j) for i in range(48) for j in range(i) if sum((words[i] & words[j]).values()) >= passages.EQUAL and sum((pairs[i] & pairs[j]).values()) >= passages.SHARED}
    got = [(i, j) for x, y in passages.likely(areas, np.arange(48), np.ones(48, dtype=bool), 48) for i, j in zip(x.tolist(), y.tolist())]
    assert set(got) == want and len(got) == len(want) > 10
    a, n, sure = passages.AROUND, passages.AROUND + 1, []
    for x, y in zip(areas[24:].tolist(), areas[:24].tolist()):
        best = []
        for u, v in ((x[:a][::-1], y[:a][::-1]), (x[a + passages.K :], y[a + passages.K :])):
            same = [[0] * n for _ in range(n)]
            for i in range(a):
                for j in range(a):
                    same[i + 1][j + 1] = max(same[i][j + 1], same[i + 1][j], same[i][j] + (u[i] == v[j] > 0))
            best.append([max(5 * same[i][j] - 2 * (i + j) for j in range(n)) for i in range(n)])
        sure.append(max(best[0][i] + best[1][j] for i in range(n) for j in range(n) if i + j + passages.K >= passages.MIN_WORDS) + passages.K >= 0)
    assert (passages.possible(areas[24:], areas[:24]) >= 0).tolist() == sure and 0 < sum(sure) < 24
    # Nothing that is possible is sorted out before.
    assert all((i + 24, i) in want for i in range(24) if sure[i])


def test_sources_alike_to_a_row_are_aligned_once(monkeypatch):
    """Two hundred documents of one word: one twenty words between meets all, but few are aligned, and none goes on alone."""
    rng, calls, align = np.random.default_rng(5), [], passages.align
    monkeypatch.setattr(passages, "align", lambda *a: calls.append(1) or align(*a))
    areas = rng.integers(1000, 60_000, (203, passages.WIDTH)).astype(np.uint16)
    areas[:200, passages.AROUND :] = 7
    areas[200:, passages.AROUND : passages.AROUND + 60] = [7] * 20 + [8] * 20 + [7] * 20
    d, need, contexts = np.arange(203), np.repeat([0, 20], [200, 3]).astype(np.int64), passages.Contexts()
    found = [*contexts(np.zeros(203, dtype=np.int64), d, np.full(203, 100), need, areas), *contexts.end()]
    d, s, p, q = (np.concatenate(c) for c in zip(*found))
    assert {(x, y) for x, y, z in zip(d.tolist(), s.tolist(), q.tolist()) if y < 200 and z == passages.ALONE - 100} == {(200, y) for y in range(200)}  # the other two are copies of it
    assert len(calls) < 60
    both = [np.array(c) for c in ([9, 9], [1, 1], [10, 20], [passages.ALONE - 30, passages.ALONE - 55])]
    assert passages._hopeful([c[:1] for c in both]) == []
    both[3][0] = 30  # may be a passage alone
    assert [x[4] for x in passages._hopeful(both)] == [[[10, 30, passages.K]]]


def test_repeated_words_meet_wherever_a_passage_is_possible():
    """Runs of a few words repeated: no pair with a possible passage is left out, though short runs are looked up by other words."""
    rng, m = np.random.default_rng(6), 180
    areas = np.zeros((m, passages.WIDTH), dtype=np.uint16)
    for i in range(m):
        n = int(rng.integers(8, 40))
        words = np.repeat(rng.integers(1, 4, 40), n)
        words[:n] = 9
        areas[i, passages.AROUND :] = words[: passages.WIDTH - passages.AROUND]
        areas[i, : passages.AROUND] = np.repeat(rng.integers(1, 4, 40), n)[: passages.AROUND]
    x, y = (k.reshape(-1) for k in np.indices((m, m)))
    x, y = x[y < x], y[y < x]
    sure = passages._worth(areas, passages._halves(areas), x, y) >= 0
    got = {(i, j) for a, b in passages.likely(areas, np.arange(m), np.ones(m, dtype=bool), m) for i, j in zip(a.tolist(), b.tolist())}
    assert passages._short_runs(areas).sum() > m // 3 and 0 < sure.sum() < len(x)
    assert set(zip(x[sure].tolist(), y[sure].tolist())) <= got


def test_crowded_seeds_that_can_meet_nothing_have_no_row(spark, monkeypatch):
    """A seed's first document and documents shorter than a passage go no further; a stretch of one word has one row."""
    monkeypatch.setattr(passages, "CROWD", 2)
    rng, vocab = random.Random(49), vocabulary(5000, 50)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    phrase = text(12)
    docs = {i: text(40) + phrase + text(40) for i in range(1, 6)} | {6: phrase + text(20)}
    docs |= {i: text(40) + ["again"] * 30 + text(40) for i in range(7, 11)}
    data = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "d long, text string").repartition(3)
    rows = Counter(r.d for r in passages.chains(data).where("hi < 0").collect())
    assert set(rows) == {2, 3, 4, 5, 8, 9, 10} and {rows[i] for i in (8, 9, 10)} == {1}


def test_a_possible_passage_ends_in_equal_words():
    """35 equal words and 15 others are no passage; what aligns is possible, and where both texts end they are not alike."""
    rng = np.random.default_rng(7)
    areas = rng.permutation(60_000)[: 4 * passages.WIDTH].reshape(4, -1).astype(np.uint16) + 1
    at = passages.AROUND
    areas[:, at - 15 : at + 20] = areas[0, at - 15 : at + 20]
    areas[2:, at - 15 : at + 45] = areas[2, at - 15 : at + 45]
    x, y = np.array([1, 3]), np.array([0, 2])
    assert (passages.possible(areas[x], areas[y]) >= 0).all()
    assert (passages._worth(areas, passages._halves(areas), x, y) >= 0).tolist() == [False, True]
    for _ in range(30):
        other = rng.integers(1, 200, (40, passages.WIDTH))
        areas = np.where(rng.random((40, passages.WIDTH)) < rng.random((40, 1)) / 2, other, rng.integers(1, 200, passages.WIDTH)).astype(np.uint16)
        areas[:, at : at + passages.K] = areas[0, at : at + passages.K]
        x, y = np.arange(1, 40), np.zeros(39, dtype=np.int64)
        worth = passages._worth(areas, passages._halves(areas), x, y)
        most = passages.possible(areas[x], areas[y], (at, at))
        assert ((worth >= 0) == (most >= 0)).all() and (worth == most)[worth >= 0].all()
        assert all(w >= 0 or not passages.align(areas[u].tolist(), areas[0].tolist(), 0, [at, at, passages.K]) for u, w in zip(x, worth))
    # Two ends of texts, 30 words alike: one has no passage there with the other, whose end is not text.
    areas = np.zeros((3, passages.WIDTH), dtype=np.uint16)
    areas[:, 20 : at + 30] = rng.permutation(60_000)[: 3 * (at + 10)].reshape(3, -1) + 1
    areas[1:, at : at + 30] = areas[0, at : at + 30]
    contexts = passages.Contexts()
    rows = [np.array([1, 2, 3]), np.full(3, at - 20), np.array([0, 30, 30]), areas]
    assert not sum(len(c[0]) for c in contexts._meet(rows, None)) and rows[2].tolist() == [0, 30, 30]


def test_a_passage_of_many_documents_has_a_row_a_document():
    """Chains inside a passage found are not aligned again; what it leaves over is."""
    rng, vocab = random.Random(47), vocabulary(5000, 48)
    text = lambda n: [rng.choice(vocab).lower().encode() for _ in range(n)]
    one, two = text(60), text(60)
    ask = lambda s, p, words: {"s": s, "base": 0, "words": b" ".join(words), "chains": [[p, 0, len(words)]]}
    got = passages._passages(b" ".join(one + two), [ask(9, 60, two), ask(3, 0, one), ask(4, 0, one), ask(2, 5, one[5:])])
    assert [x[:3] for x in got] == [(3, 0, 60), (9, 60, 120)]


def test_repeats_between_the_first_and_the_previous_are_removed(spark):
    """The pipeline's stage cuts a passage whose source is neither the first nor the previous document of its seeds."""
    rng, vocab = random.Random(43), vocabulary(5000, 44)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    parts = [text(12) for _ in range(5)]
    mixed = lambda: sum((text(30) + parts[k] for k in rng.sample(range(5), 5)), text(9))
    joined = lambda: sum((p + text(1) for p in parts), [])
    docs = {1: mixed(), 2: mixed(), 3: text(20) + joined() + text(20), 4: mixed(), 5: mixed(), 6: text(35) + joined() + text(9)}
    out = passages.remove_repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3))
    left = {r.doc_id: r.text.split() for r in out.collect()}
    assert len(left[6]) <= len(docs[6]) - 60 and all(left[i] == docs[i] for i in range(1, 6))


def test_ends_go_the_same_way_through_equal_words_alone(monkeypatch):
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijklmnopqrstuvwxyz").encode() for _ in range(rng.randint(0, 16))] for _ in range(2))
        got = passages._ahead(a, b)
        with monkeypatch.context() as m:
            m.setattr(passages, "FEW", 0)
            assert passages._ahead(a, b) == got


def test_seeds_meet_all_earlier_documents_or_crowd():
    rng = np.random.default_rng(5)
    h, d = rng.integers(0, 9, 600), rng.integers(0, 60, 600)
    h[:200], d[:200] = rng.integers(9, 40, 200), rng.integers(0, 60, 200)
    order = np.lexsort((d, h))
    h, d, p = h[order], d[order], np.arange(600)
    holders = {k: sorted(set(d[h == k].tolist())) for k in h.tolist()}
    want = {(k, x, y) for k, own in holders.items() if len(own) <= passages.CROWD for i, x in enumerate(own) for y in own[1 : max(i - 1, 1)]}
    for size in (1, 7, 600):
        crowds, got, crowded = passages.Crowds(), set(), []
        for a in [*range(0, 600, size), None]:
            cols = [c[:0] if a is None else c[a : a + size] for c in (h, d, p)]
            (x, y, px, py), rows = crowds(cols, end=a is None)
            got |= {(int(h[i]), int(u), int(v)) for u, v, i, j in zip(x, y, px, py) if h[i] == h[j]}
            crowded += rows[2].tolist()
        assert got == want and len(want) > 100
        assert sorted(crowded) == [i for i in range(600) if len(holders[int(h[i])]) > passages.CROWD] and crowded


@pytest.mark.parametrize("edits", [3, 6, 9])
def test_recall_of_edited_passages(spark, edits):
    """Of 60-word passages with edits, all of similarity 0.8 and more, at least nine tenths are found."""
    rng, vocab = random.Random(30 + edits), vocabulary(5000, 31)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = {}
    for i in range(100):
        shared = text(60)
        docs[2 * i] = text(100) + shared + text(100)
        docs[2 * i + 1] = text(100) + fuzzy(shared, edits, rng, vocab) + text(100)
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    assert all(r.doc_id == r.source_id + 1 and r.source_id % 2 == 0 and r.start >= 90 for r in got)
    assert len({r.doc_id for r in got}) >= 90


def test_passages_of_columns_that_clash(spark, planted):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in planted.items()], "doc_id long, text string")
    named = ("d", "_d", "s", "h", "_found", "passage_of", "PASSAGES_FOUND", "lo", "chains")
    out = passages.remove_repeats(df.withColumns({c: F.lit(c) for c in named}))
    assert out.columns == ["doc_id", "text", *named] and all(r[c] == c for r in out.limit(3).collect() for c in named)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in passages.remove_repeats(df).collect()}


def test_edits_near_both_ends_of_a_passage():
    source = [b"w%d" % i for i in range(56)]
    words = [b"x" + w if i in (4, 9, 45, 50) else w for i, w in enumerate(source)]
    p = np.array([12, 15, 19, 22, 25, 28, 31, 34, 38], dtype=np.int32)  # the 35 words between the inner edits have all the seeds
    ids = np.full(len(p), 2)
    found = passages._chains(np.append(ids, 2), np.append(ids - 1, 2), np.append(p, 56), np.append(p, -1))
    assert found == [(2, 1, 0, 85, [[12, 12, 31]])]
    assert passages.align(words, source, 0, found[0][4][0]) == [(0, 56, 0, 56, 0.9286)]


def test_sub_chains_of_a_chain_that_fails():
    one, two = [b"a%d" % i for i in range(60)], [b"b%d" % i for i in range(60)]
    edited = lambda w, *at: [b"x" + x if i in at else x for i, x in enumerate(w)]
    source = one + two
    words = edited(one, 30) + [b"n%d" % i for i in range(75)] + edited(two, 30)
    pieces = [0, 0, 30, 31, 31, 29, 135, 60, 30, 166, 91, 29]
    assert sorted(passages.align(words, source, 0, pieces)) == [(0, 60, 0, 60, 0.9833), (135, 195, 60, 120, 0.9833)]
    long = [b"c%d" % i for i in range(200)]
    at = [*range(14, 100, 15), *range(114, 200, 15)]
    copy = edited(long, *at)
    copy[100:100] = [b"n%d" % i for i in range(100)]
    cuts = [0, *[x for i in at for x in (i, i + 1)], 200]
    runs = [(a, z) for a, z in zip(cuts[::2], cuts[1::2]) if z > a]
    runs = [y for a, z in runs for y in ([(a, 100), (100, z)] if a < 100 < z else [(a, z)])]
    pieces = [x for a, z in runs for x in (a + 100 * (a >= 100), a, z - a)]
    assert sorted(x[:4] for x in passages.align(copy, long, 0, pieces)) == [(0, 100, 0, 100), (200, 300, 100, 200)]
    rng, vocab = random.Random(6), [b"w%d" % i for i in range(12)]
    for _ in range(100):
        a, b = ([rng.choice(vocab) for _ in range(300)] for _ in range(2))
        trio, x, y = [], 0, 0
        while x < 250 and y < 250:
            k = rng.randint(5, 25)
            b[y : y + k] = a[x : x + k]
            trio += [x, y, k]
            x, y = x + k + rng.randint(0, 12), y + k + rng.randint(0, 12)
        n = len(trio) // 3
        every = [p for i in range(n) for j in range(i + 1, n + 1) for p in passages.align(a, b, 0, trio[3 * i : 3 * j])]
        got = passages.align(a, b, 0, trio)
        assert bool(got) == bool(every) and all(g[4] >= 0.8 and g[1] - g[0] >= 50 for g in got)


def test_chain_is_the_best_one():
    rng = random.Random(4)
    for _ in range(200):
        pieces = sorted((rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 12)) for _ in range(rng.randint(1, 8)))
        best = {}

        def value(i):
            if i not in best:
                p, q, w = pieces[i]
                best[i] = w + max([0.0, *(value(j) - passages.GAP_COST * (p - a - v + q - b - v) for j, (a, b, v) in enumerate(pieces) if a + v <= p and b + v <= q)])
            return best[i]

        top = max(map(value, range(len(pieces))))
        path = passages.chain(pieces)[0]
        got = sum(pieces[i][2] for i in path) - passages.GAP_COST * sum(pieces[j][0] + pieces[j][1] - sum(pieces[i][:2]) - 2 * pieces[i][2] for i, j in zip(path, path[1:]))
        assert abs(got - top) < 1e-9
        assert sorted(i for c in passages.chain(pieces) for i in c) == list(range(len(pieces)))


# Token counts


def test_token_counts(rows, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    at = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(at)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, at).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.token_counts(empty(docs), at).count() == 0
    rng, count = random.Random(2), token_counts.Counter(token_counts.Merges(at))
    odd = ["".join(rng.choice("ab c\x1c\x85\xa0 \t\n'sdl12²½٣é漢😀!<|>_") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    odd += ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "a" * 3000, "ab" * 2000, " " * 50, "\n\n \n"]
    assert count([x.encode() for x in odd]) == [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]


# Language model


def _counts(rows, held):
    """Brute force: counts of n-grams of 1 to 3 tokens in training documents ("" begins a text, None ends it)."""
    toks = {i: words_of(lower(t)) + [None] for i, t in rows}
    c = [Counter(), Counter(), Counter()]
    for i, ws in toks.items():
        if not held[i]:
            c[0].update(ws)
            full = ["", *ws]
            c[1].update(zip(full, full[1:]))
            c[2].update(zip(full, full[1:], full[2:]))
    return toks, c, sum(not held[i] for i in toks)


def _chance(w, context, c, begun, s):
    """P(w | context) by the formula, context being at most two tokens."""
    if not context:
        return (c[0][w] - s.discount if c[0][w] else s.discount * len(c[0])) / sum(c[0].values())
    size = (begun if context == ("",) else c[0][context[0]]) if len(context) == 1 else c[1][context]
    m = s.mass[len(context)]
    return (c[len(context)][(*context, w)] + m * _chance(w, context[1:], c, begun, s)) / (size + m)


def _smoothing(c, begun):
    stats = [language_model._statistics(np.array([language_model.ENDED if k is None else 0 for k in x] if n == 1 else [0] * len(x), dtype=np.uint64), np.array(list(x.values()), dtype=np.int64), n) for n, x in enumerate(c, 1)]
    return language_model.Smoothing(stats, begun)


def test_lm_scores(rows, docs, monkeypatch):
    monkeypatch.setattr(language_model, "LANE", 50)
    rows = [*rows, (500, rows[3][1]), (501, rows[5][1] + " and a tail"), (505, rows[7][1])]
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(rows[-3:], "doc_id long, text string")).withColumn("piece", F.lit(1)).withColumn("body", F.lit("x"))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    toks, c, begun = _counts(rows, held)
    s = _smoothing(c, begun)
    n, v = sum(c[0].values()), len(c[0])
    monkeypatch.setattr(language_model, "SAMPLE", 2)
    got = {r.doc_id: r for r in language_model.lm_scores(docs, shard_bits=2).collect()}
    assert set(got) == set(toks)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c[0] for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((c[0][w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        full = ["", *ws]
        score = sum(log10(_chance(w, tuple(full[max(0, k - 1) : k + 1]), c, begun, s)) for k, w in enumerate(ws))
        assert r.score == pytest.approx(score, rel=1e-9)
    # The chances of all words after a state, and of the unseen one, add up to one.
    for h in [("",), ("", toks[3][0]), tuple(toks[3][:2]), ("never", "seen")]:
        assert sum(_chance(w, h, c, begun, s) for w in [*c[0], "\0"]) == pytest.approx(1.0)
    assert language_model.lm_scores(empty(docs)).count() == 0
    alone = language_model.lm_scores(docs.where(F.col("doc_id").isin([i for i in held if held[i]]))).collect()
    assert alone and all(r.score == r.base_score and r.train_tokens == 0 for r in alone)


def test_lm_hot_ngrams_take_the_other_way(spark, monkeypatch):
    rng, vocab = random.Random(41), vocabulary(60, 42)
    rows = [(i, " ".join(rng.choice(vocab[: 60 if i % 2 else 2]) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24).cache()
    hot = language_model._hot(language_model._pieces(docs, "text"))
    assert all(len(h) for h in hot)
    with_hot = {r.doc_id: (r.n_known, r.base_score, r.score) for r in language_model.lm_scores(docs).collect()}
    monkeypatch.setattr(language_model, "_hot", lambda pieces: [np.zeros(0, dtype=np.uint64)] * 3)
    without = {r.doc_id: (r.n_known, r.base_score, r.score) for r in language_model.lm_scores(docs, shard_bits=6).collect()}
    assert {i: x[0] for i, x in with_hot.items()} == {i: x[0] for i, x in without.items()}
    assert all(with_hot[i] == pytest.approx(without[i], rel=1e-9) for i in without)


def test_lm_repeated_rows(docs):
    twice = language_model.lm_scores(docs.unionByName(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("score").alias("k"))
    assert twice.where("n <> 2 or k > 1").count() == 0


# Toxicity


def test_toxicity(spark):
    rng, vocab = random.Random(8), vocabulary(300, 9)
    bad = ["blorg", "snarfing", "snarfed", "snarfer"]
    rows = []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (1002, "you snarfling " * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    out = [(i, y) for i, _, y in rows if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in out) >= 0.97 * len(out)
    assert got[1000].score == got[1001].score < 0.3 and got[1002].predicted == 1
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    # Held-out labels teach nothing.
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, other).collect()} == {i: r.score for i, r in got.items()}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {toxicity.Model({}, np.array([-30.0, 0.0])).score(np.zeros((1, 5)))[0]}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_clauses():
    lex = toxicity.Lexicon({"fool": 2.0, "snarf*": 1.0})
    kinds = lambda t: [round(x, 3) for x in toxicity.evidence(lex, t)]
    assert kinds("you are a fool. good day") == [2.0, 0, 0, 0, 0]
    assert kinds("a fool, that is you. fool, you") == [0, 4.0, 0, 0, 0]
    assert kinds("what a fool you are") == [2.0, 0, 0, 0, 0]
    assert kinds("a fool, a snarfer!") == [0, 3.0, 0, 0, 0]
    assert kinds("he is not a fool") == [0, 0, 2.0, 0, 0]
    assert kinds("not that it was ever so bad a fool") == [0, 2.0, 0, 0, 0]
    assert kinds("she said, he is a fool. fool") == [0, 2.0, 0, 2.0, 0]
    assert kinds("we kill you; kill time; do not kill you") == [0, 0, 1.0, 0, 1.0]
    assert kinds("foolish foo") == [0.0] * 5


def _brute_evidence(patterns, closed, text):
    """The grammar by its rules, word by word, without transducers."""
    import re

    tokens = re.findall(r"[^\W\d_]+|[.,;:!?|\n]", text.lower())
    out = dict.fromkeys(toxicity.KINDS, 0.0)

    def cls(w):
        hits = [v for p, v in patterns.items() if w == p or p.endswith("*") and w.startswith(p[:-1])]
        return ("insult", max(hits)) if hits else (next((c for c, ws in closed.items() if w in ws), ""), 1.0)

    kinds = [cls(w) for w in tokens]
    for i, (c, v) in enumerate(kinds):
        if c not in ("insult", "threat"):
            continue
        begin = max([k + 1 for k in range(i) if kinds[k][0] in ("mark", "stop")], default=0)
        end = min([k for k in range(i, len(kinds)) if kinds[k][0] in ("mark", "stop")], default=len(kinds))
        sentence = max([k + 1 for k in range(i) if kinds[k][0] == "stop"], default=0)
        if any(kinds[k][0] == "says" for k in range(sentence, i)):
            out["reported"] += v
        elif any(kinds[k][0] == "not" for k in range(max(begin, i - toxicity.NEAR_NOT), i)):
            out["denied"] += v
        else:
            aimed = any(kinds[k][0] == "target" for k in range(max(begin, i - toxicity.NEAR_TARGET), min(end, i + toxicity.NEAR_TARGET + 1)))
            if c == "insult":
                out["aimed" if aimed else "plain"] += v
            elif aimed:
                out["menace"] += v
    return [out[k] for k in toxicity.KINDS]


def test_grammar_against_its_rules():
    names = {toxicity.THREAT: "threat", toxicity.TARGET: "target", toxicity.NOT: "not", toxicity.SAYS: "says", toxicity.MARK: "mark", toxicity.STOP: "stop"}
    closed = {n: {w for w, (c, _) in toxicity.CLOSED.items() if c == k} for k, n in names.items()}
    rng, patterns = random.Random(12), {"fool": 2.0, "snarf*": 1.0, "snarfing": 3.0}
    lex = toxicity.Lexicon(patterns)
    vocab = ["you", "they", "not", "never", "said", "kill", "fool", "snarfed", "snarfing", ",", ".", "\n", *["w%s" % c for c in "abcdefgh"]]
    for _ in range(3000):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))
        assert toxicity.evidence(lex, text) == pytest.approx(_brute_evidence(patterns, closed, text)), text


def test_grammar_decides(spark):
    """Denial, report and threat change the prediction of the same words."""
    rng, vocab = random.Random(18), vocabulary(300, 19)
    rows = []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 40))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["blorgs", "snarfing"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    cases = {1000: ("you are blorgs", 1), 1001: ("you are not blorgs", 0), 1002: ("she said you are blorgs", 0), 1003: ("we will kill you", 1), 1004: ("we will kill time", 0), 1005: ("we will not kill you", 0), 1006: ("abc blorgs abc", 1)}
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(i, t) for i, (t, _) in cases.items()] + [(2000, long), (2001, long + " blorgs")], "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id < 50")).withColumns({c: F.lit("mine") for c in ("i", "y", "toxic", "score", "p")})
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert {i: got[i].predicted for i in cases} == {i: y for i, (_, y) in cases.items()}
    assert (got[2000].predicted, got[2001].predicted) == (0, 1)


# Licences


def test_licenses(spark, docs):
    bsd = licenses.TEMPLATES["bsd-3-clause"]
    rows = [(1, "some words here\nReleased under the MIT license\nmore of it"), (2, bsd), (3, "Copyright (c) 2020 Someone\n" + bsd.lower() + "\nthe end of it all"), (4, "Licensed under the Apache Licence, Version 2.0"), (5, None), (6, ""), (7, "MIT"), (8, "Licensed under CC BY-NC 4.0.\nAll Rights Reserved")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 9)] == ["mit", "bsd-3-clause", "bsd-3-clause", None, None, None, None, "all-rights-reserved"]
    assert got[8].licenses == "all-rights-reserved,cc-by-nc-4.0" and got[2].dice == 1.0
    assert licenses.license_scan(docs).where("n_licenses > 0").count() == 0
    assert licenses.license_scan(empty(docs)).count() == 0


def _brute_licenses(text, templates, threshold=0.85):
    """All units and all windows, by sets, without pruning."""
    import re

    def grams(x):
        w = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", x.lower())
        return list(zip(w, w[1:]))

    lines = text.split("\n")
    units = [*lines, text, *re.split(r"\n(?:[\t\f\r ]*\n)+", text)]
    best = {}
    for name, t in templates.items():
        own, flat = set(grams(t)), grams(text)
        sets = [set(grams(u)) for u in units] + [set(flat[i : i + len(grams(t))]) for i in range(len(flat)) if flat[i] in own]
        best[name] = max([2 * len(own & u) / (len(own) + len(u)) for u in sets if u], default=0.0)
    return {n: d for n, d in best.items() if d >= threshold}


def test_licenses_within_lines_and_repeated(spark):
    t = licenses.TEMPLATES
    rows = [(1, "The library is fine. Released under the MIT License. It is used by many people every day."), (2, t["isc"].replace("\n", "\n\n") + "\n\nsome code\n\n" + t["isc"]), (3, licenses.full_texts()["mit-text"]), (4, "Copyright 2009 The Go Authors. All rights reserved.\nUse of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."), (5, "word " * 30_000 + t["apache-2.0-header"].replace("\n", " ") + " word" * 30_000), (5, "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("mine"))
    got = [(r.doc_id, r.license, r.licenses) for r in licenses.license_scan(df, {**t, **licenses.full_texts()}).collect()]
    found = {(i, x) for i, _, names in got for x in names.split(",")}
    assert found >= {(1, "mit"), (2, "isc"), (3, "mit-text"), (4, "bsd-style-notice"), (4, "all-rights-reserved"), (5, "apache-2.0-header"), (5, "cc-by-4.0"), (5, "cc-by-sa-4.0")} and len(got) == 6
    rng, names = random.Random(5), sorted(t)
    scanner = licenses.Scanner(t, 0.85)
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = t[rng.choice(names)].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "the license", "\n", "\n\n", "\n \n", "of the"])
            parts.append(rng.choice(["", "before it "]) + " ".join(w) + rng.choice(["", " after", " \xa0"]))
        text = rng.choice(["\n", "\n\n", " "]).join(parts)
        want, have = _brute_licenses(text, t), scanner.scan(text)
        assert set(want) == set(have) and all(have[n] == pytest.approx(want[n]) for n in want), text


def test_registered_query_knows_whole_licences(spark, tmp_path):
    full = licenses.full_texts()
    assert set(full) == {"apache-2.0-text", "gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "lgpl-3.0-text", "mit-text", "mpl-2.0-text", "unlicense-text"}
    rows = [(i, "Copyright (c) 2020 Someone\n\n" + t.upper() + "\n\ndef main():\n    pass") for i, t in enumerate(full.values())] + [(100, full["mit-text"]), (101, "no licence here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op1_license_scans(spark, str(tmp_path)).collect()}
    assert all(n in got[i].licenses.split(",") for i, n in enumerate(full))  # the MPL and others quote their own notice, which scores more
    assert got[100].license == "mit-text" and got[100].dice == 1.0 and got[101].n_licenses == 0


def test_size_bounds_lose_nothing():
    s = licenses.Scanner(licenses.TEMPLATES, 0.6)
    rng, pool = random.Random(3), [w for t in licenses.TEMPLATES.values() for w in licenses.WORD.findall(t.lower())]
    for _ in range(400):
        k = rng.randrange(len(pool) - 40)
        unit = licenses.bigrams(" ".join(w for w in pool[k : k + rng.randint(2, 40)] if rng.random() < 0.95))
        want = {n: d for n, g in s.sets.items() if unit and (d := 2 * len(unit & g) / (len(unit) + len(g))) >= 0.6}
        assert dict(s.scored(unit)) == want


# Pages


PAGE = '<!DOCTYPE html><html><head><title>T &am</title><script>var t="</p>";</script><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy</div>{0}<aside>Side</aside><form><input><button>Go</button></form><section class="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; host &middot; Foot</footer></body></html>'


def test_main_text(spark):
    article = "<article><h1>A &amp; B</h1><p><b>One\n two<br>three</b><p>x&lt;y &#233;<div class='cookie-notice'>Eat</div><ul><li>l1<li>l2</ul></article>"
    soup = "<div><p>Shared slogan</p></div><div>{}</div><p>Shared end</p>"
    rows = [
        (1, "http://h/a/1", PAGE.format(article)),
        (2, "http://h/b/1", PAGE.format(soup.format("<p>Own one</p>"))),
        (3, "http://h/b/2", PAGE.format(soup.format("<p>Own two</p>"))),
        (4, "http://h/b/3", PAGE.format(soup.format("<p>Own two</p>"))),
        (5, None, None),
        (6, "http://h/c", ""),
        (7, "http://other/b/1", PAGE.format("<main><p>Only <i>m</i>ain</p>")),
        (8, "x", "plain < text &notit; <"),
        (9, "http://h/d", "<article><p>cut off <scr"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in html_text.main_text(df).coalesce(1).collect()}
    assert got[1].text == "A & B One two three x<y é l1 l2" and got[1].named
    assert got[7].text == "Only main" and got[9].text == "cut off"
    assert got[5].text == got[6].text == "" and got[5].n_chars == 0
    assert got[8].text.startswith("plain < text")
    assert [got[i].text for i in (2, 3, 4)] == ["Own one", "Own two", "Own two"] and not got[2].named
    assert all(got[i].n_chars == len(got[i].text) for i in got)
    assert html_text.main_text(df.where("false")).count() == 0


def test_all_of_the_named_article():
    def text(x):
        lines, own = html_text.blocks(x)
        return [lines[k] for k in own] or lines, bool(own)

    assert text("<p>out</p><article><p>one</p><article>in</article></article><p>out</p><article>second part</article>") == (["one", "in", "second part"], True)
    assert text("<section class='content'>short</section><i>x</i><section class='content'>much longer</section>") == (["short", "much longer"], True)
    assert text("<main><div>The article is here</div><article class='card'>Card</article><p>and goes on</p></main>") == (["The article is here", "Card", "and goes on"], True)
    assert text("<main><p>Lead</p><article>The article is here</article></main>") == (["The article is here"], True)
    assert text("<article><div class='content'>a</div><p>b</p></article><p>c</p>") == (["a", "b"], True)
    assert text("<nav>m</nav><article><p>A text</p></article><div>Unmarked after</div><p>more after</p>") == (["A text"], True)
    assert text("<main><article><p>The text</p></article><p>tail</p></main><p>outside</p>") == (["The text"], True)
    assert text("<article></article><main>m</main>") == (["m"], True) and text("<article></article><p>p</p>") == (["p"], False)


def _silent(n, hosts, rng):
    """Pages without article markup: a template by host, own lines, runs of copies, a near copy."""
    rows, want = [], {}
    for i in range(n):
        host = i % hosts
        own = [f"Own text {i} {w}" for w in range(rng.randint(1, 4))]
        rows.append((i, f"http://h{host}/p/{i:05d}", own, host))
    for k, i in enumerate(range(0, n, 7)):  # copies under the next paths
        rows += [(n + 10 * k + c, f"{rows[i][1]}-{c}", rows[i][2], rows[i][3]) for c in range(4)]
    out = []
    for key, url, own, host in rows:
        body = "".join(f"<p>{x}</p>" for x in own)
        out.append((key, url, f"<div>Menu of {host}</div><div>Slogan</div>{body}<div>Below it all {host}</div>"))
        want[key] = " ".join(own)
    return out, want


def test_differencing_is_the_same_however_pages_are_cut(spark):
    """Also with one host's pages over many partitions, copies in a row, repeated rows and a named page between."""
    rows, want = _silent(90, 3, random.Random(3))
    rows += rows[:5] + [(900, "http://h0/p/00000-5", "<div>Menu of 0</div><div>Slogan</div><article>An article</article><p>Below it all 0</p>"), (901, "http://alone/x", "<p>Menu of 0</p><p>whole page</p>")]
    want |= {900: "An article", 901: "Menu of 0 whole page"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("r", "host", "key", "lines", "near")})
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            seen.append(sorted((r.page_id, r.text) for r in html_text.main_text(df.repartition(n)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1] == seen[2] and dict(seen[0]) == want and len(seen[0]) == len(rows)


def test_differencing():
    a, b = ["s", "own", "t", "own2", "u"], ["s", "x", "t", "u", "v"]
    assert html_text.shared_lines(a, b) == {0, 2, 4}
    assert html_text.difference(a, [b]) == ["own", "own2"]
    assert html_text.difference(a, [["s", "own"], b]) == ["own", "t", "own2", "u"] and html_text.difference(a, [a]) == a and html_text.difference(a, []) == a
    many = [str(i) for i in range(30_000)]
    assert len(html_text.shared_lines(many, many[::2])) == 15_000
    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        at = sorted(html_text.shared_lines(x, y))
        assert len(at) == _lcs(x, y)
        it = iter(y)
        assert all(x[i] in it for i in at)


# Mixing


def brute_mix(rows, domain, weights, budget, max_epochs):
    leaves = {}
    for i, t, lang, source in rows:
        leaves.setdefault((domain(source), lang or "", source or ""), []).append((i, len(words_of(t))))
    return mixing.leaf_budgets(budget, {k: sum(n for _, n in v) for k, v in leaves.items()}, weights, max_epochs), leaves


def test_mixing(spark):
    rng, vocab = random.Random(5), vocabulary(50, 5)
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), rng.choice(["a1", "a1", "a1", "b2", "c3", None])) for i in range(300)]
    rows += [(None, "x y z", "en", "a1"), (500, None, "en", "a1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("epoch", F.lit("old")).repartition(3)
    domain = F.substring(F.coalesce("source", F.lit("")), 1, 1)
    weights = {("a",): 3, ("b",): 5, ("*", "en"): 2}
    total = sum(len(words_of(t)) for _, t, _, _ in rows)
    out = mixing.mix(df, domain, weights, budget_share=0.7, max_epochs=2)
    got = out.collect()
    budgets, leaves = brute_mix(rows, lambda s: (s or "")[:1], weights, int(total * 7 // 10), 2)
    assert sum(budgets.values()) == total * 7 // 10
    for leaf, n in budgets.items():
        mine = [r for r in got if (r.domain, r.lang or "", r.source or "") == leaf]
        assert sum(r.take_tokens for r in mine) == n
        assert sum(r.take_tokens < r.n_tokens for r in mine) <= 1
        size = dict(leaves[leaf])
        seen = Counter((r.doc_id, r.epoch) for r in mine)
        assert all(k == 1 for k in seen.values()) and all(r.n_tokens == size[r.doc_id] for r in mine)
        whole = n // max(1, sum(size.values()))
        assert all(seen[i, e] for i in size for e in range(whole)) and all(e <= whole for _, e in seen)
    assert {tuple(r) for r in mixing.mix(df.repartition(7), domain, weights, budget_share=0.7, max_epochs=2).collect()} == {tuple(r) for r in got}
    named = ("h", "leaf", "whole", "rest", "_lang", "_id", "range", "own0", "cut_h", "n", "one", "k")
    clash = mixing.mix(df.withColumns({c: F.lit(c) for c in named}), domain, weights, budget_share=0.7, max_epochs=2)
    assert all(r[c] == c for r in clash.limit(5).collect() for c in named)
    assert {tuple(r) for r in clash.drop(*named).collect()} == {tuple(r) for r in got}
    assert mixing.mix(df.where("false"), domain, weights, budget_share=0.7).count() == 0
    assert mixing.mix(df, domain, weights, budget_tokens=0).count() == 0


def test_share():
    assert mixing.share(100, [("a", 1, 1000), ("b", 1, 10), ("c", 2, 1000)]) == {"a": 30, "b": 10, "c": 60}
    assert mixing.share(100, [("a", 1, 10), ("b", 5, 20)]) == {"a": 10, "b": 20}
    assert mixing.share(10, [("a", 1, 50), ("b", 1, 50), ("c", 1, 50)]) == {"a": 4, "b": 3, "c": 3}
    # A shortage below goes to siblings before it goes to the other branch.
    got = mixing.leaf_budgets(100, {("x", "en", "s"): 5, ("x", "en", "t"): 100, ("y", "en", "s"): 100}, {}, 1)
    assert got == {("x", "en", "s"): 5, ("x", "en", "t"): 45, ("y", "en", "s"): 50}


def test_mixing_takes_no_text_back_from_python(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * i), "en", f"s{i % 3}") for i in range(40)] + [(None, None, None, None)], "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs, registry.source_domain(), {}, budget_share=0.6).select("doc_id", "epoch", "n_tokens", "take_tokens")
    assert {(r.doc_id, r.n_tokens) for r in mixed.collect()} <= {(i, i) for i in range(40)} and mixed.count() > 0
    assert "MapInArrow" not in mixed._jdf.queryExecution().toString()
