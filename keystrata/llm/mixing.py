"""Mixing sources to target weights: hierarchical budgets and seeded epochs.

Leaves are (domain, language, source). The budget runs down the tree: a node's
children share it by weight, each up to what its documents hold times
``max_epochs``; what a child can't use goes to its siblings first, and only what
all of them can't use stays with the ancestors, whose other children get it.

A leaf's budget is whole epochs and a rest. The rest is a prefix of the next
epoch, whose order is a hash of seed, epoch and identifier. Its end is found
from sums over 4,096 ranges of the hash (combined before the shuffle) and a
running sum inside the one range that holds it, so a leaf with a third of all
rows is never gathered. All that is broadcast has one row a leaf.

Tokens are words [^\\x20\\x09-\\x0D]+. Null languages and sources are the empty
name; null identifiers come first among equal hashes. Texts without words cost
nothing. Rows that repeat an identifier within a leaf stand together: each gets
what the first of them gets. Columns named like the results are replaced; other
extra columns stay. An empty table or budget selects nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import CHUNK_ROWS, durable, texts

#: Leaves that the driver's tree may have; a table with more is refused.
MAX_LEAVES = 50_000
Leaf = tuple[str, str, str]
RESULTS = ("domain", "epoch", "n_tokens", "take_tokens")


def share(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """Budget by weight among (name, weight, capacity), none above its capacity.

    Those that can't use their share are filled, fullest first, and the others
    share what is left; the units that rounding leaves go by largest fraction,
    then name.
    """
    out = {name: 0 for name, _, _ in children}
    open_ = sorted((c for c in children if c[1] > 0 and c[2] > 0), key=lambda c: (Fraction(c[2], c[1]), c[0]))
    weight = sum(w for _, w, _ in open_)
    while open_ and open_[0][2] * weight <= budget * open_[0][1]:
        name, w, capacity = open_.pop(0)
        out[name], budget, weight = capacity, budget - capacity, weight - w
    if open_:
        for name, w, _ in open_:
            out[name] = budget * w // weight
        left = budget - sum(out[name] for name, _, _ in open_)
        for name, _, _ in sorted(open_, key=lambda c: (-(budget * c[1] % weight), c[0]))[:left]:
            out[name] += 1
    return out


def leaf_budgets(budget: int, tokens: Mapping[Leaf, int], weights: Mapping[tuple, int], max_epochs: int) -> dict[Leaf, int]:
    """Budget of each leaf. ``weights`` has positive integers by path, ``("web",)`` or ``("web", "en")``; a path without one weighs 1."""
    tree: dict[str, dict[str, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
    for (domain, lang, source), n in tokens.items():
        tree[domain][lang][source] = n * max_epochs
    held = {d: {l: sum(s.values()) for l, s in langs.items()} for d, langs in tree.items()}
    out: dict[Leaf, int] = {}
    for d, for_domain in share(budget, [(d, weights.get((d,), 1), sum(held[d].values())) for d in tree]).items():
        for l, for_lang in share(for_domain, [(l, weights.get((d, l), weights.get(("*", l), 1)), held[d][l]) for l in tree[d]]).items():
            for s, n in share(for_lang, [(s, weights.get((d, l, s), 1), c) for s, c in tree[d][l].items()]).items():
                out[d, l, s] = n
    return out


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with n_tokens. Texts go to Python, but only counts come back, so that an executor doesn't hold them twice."""

    @F.arrow_udf(T.LongType())
    def count(column: pa.Array) -> pa.Array:
        parts = (column.slice(at, CHUNK_ROWS) for at in range(0, len(column), CHUNK_ROWS))
        return pa.array([len(x.split()) for part in parts for x in texts(part)], pa.int64())

    return docs.withColumn("n_tokens", count(text_col))


def mix(docs: DataFrame, domain: Column, weights: Mapping[tuple, int], budget_share: float | None = None, budget_tokens: int | None = None, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` once for each epoch they are selected in, with domain, epoch, n_tokens, take_tokens.

    The budget is ``budget_tokens``, or ``budget_share`` of all tokens. The one
    document at a leaf's end has take_tokens below its n_tokens.
    """
    spark = docs.sparkSession
    names = ["_domain", "_lang", "_source"]
    key = [F.coalesce(x, F.lit("")).alias(n) for x, n in zip((domain, F.col("lang"), F.col("source")), names)]
    # The documents' own columns go by numbers meanwhile, so that no name of ours is one of theirs.
    other = [c for c in docs.columns if c.lower() not in RESULTS]
    own = {c: f"own{i}" for i, c in enumerate(other)}
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), *key, *[docs[c].alias(n) for c, n in own.items()])
    text = next(n for c, n in own.items() if c.lower() == text_col.lower())
    meta = durable(_counted(docs.select("_id", *names, text), text).drop(text))
    # Rows that repeat an identifier in a leaf count once in the order and together in the sums.
    units = meta.groupBy(*names, "_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("one"))
    rows = meta.groupBy(*names).agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves; give coarser sources")
    tokens = {(r[0], r[1], r[2]): int(r[3]) for r in rows}
    total = sum(tokens.values())
    budget = budget_tokens if budget_tokens is not None else int(Fraction(str(1.0 if budget_share is None else budget_share)) * total)
    budgets = leaf_budgets(budget, tokens, weights, max_epochs)
    plan = [(*leaf, k, n // tokens[leaf], n % tokens[leaf]) for k, (leaf, n) in enumerate(sorted(budgets.items())) if n]
    kinds = "_domain string, _lang string, _source string, leaf int, whole long, rest long"
    leaves = spark.createDataFrame(plan, kinds)
    # Sixteen hex digits of a hash that other engines have as well.
    order = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("_id").cast("string")).cast("binary")), 1, 16)
    m = units.join(F.broadcast(leaves.where("rest > 0")), names).select("leaf", "rest", "_id", "n", "one", order.alias("h")).withColumn("range", F.substring("h", 1, 3))
    sums = m.groupBy("leaf", "rest", "range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("leaf").orderBy("range"))
    edge = sums.withColumn("upto", upto).where("upto >= rest and upto - n < rest").select("leaf", "range", (F.col("upto") - F.col("n")).alias("before"))
    inside = m.join(F.broadcast(edge), ["leaf", "range"])
    upto = F.col("before") + F.sum("n").over(W.partitionBy("leaf").orderBy("h", "_id").rowsBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).where("upto >= rest and upto - n < rest")
    cut = durable(last.select("leaf", F.col("h").alias("cut_h"), F.col("_id").alias("cut_id"), F.least(F.col("one"), F.col("rest") - F.col("upto") + F.col("n")).alias("cut_take")))
    leaves = leaves.join(F.broadcast(cut), "leaf", "left")

    full = _counted(docs, text)
    picked = full.join(F.broadcast(leaves), names).withColumn("h", order)
    before = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("_id") < F.col("cut_id")))
    at = (F.col("h") == F.col("cut_h")) & (F.col("_id") == F.col("cut_id"))
    take = F.when(before, F.col("n_tokens")).when(at, F.least("n_tokens", "cut_take"))
    epochs = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("whole") - 1, F.lit(0))), lambda e: F.struct(e.cast("int").alias("epoch"), F.col("n_tokens").alias("take")))).otherwise(F.array().cast("array<struct<epoch:int,take:bigint>>"))
    more = F.when(take.isNotNull(), F.array(F.struct(F.col("whole").cast("int").alias("epoch"), take.alias("take")))).otherwise(F.array().cast("array<struct<epoch:int,take:bigint>>"))
    return picked.withColumn("_e", F.explode(F.concat(epochs, more))).select(*[F.col(n).alias(c) for c, n in own.items()], F.col("_domain").alias("domain"), F.col("_e.epoch").alias("epoch"), "n_tokens", F.col("_e.take").alias("take_tokens"))


def _shares(level: str, above: str, keys: str, name: str, weight: str) -> str:
    """SQL of the water-filling of one level: budgets of ``above`` (its keys, b) among the nodes of ``level``."""
    part = f"PARTITION BY {keys}" if keys else ""
    using = f"JOIN {above} USING ({keys})" if keys else f"CROSS JOIN {above}"
    cols = f"{keys}, {name}" if keys else name
    return f"""
{level}_c AS (SELECT {cols}, {weight} AS w, sum(t)::HUGEINT * 2 AS cap FROM tokens GROUP BY {cols}),
{level}_o AS (SELECT c.*, b, sum(w) OVER q - w AS w_before, sum(cap) OVER q - cap AS cap_before, sum(w) OVER ({part}) AS w_all FROM {level}_c c {using} WHERE cap > 0 WINDOW q AS ({part} ORDER BY cap * 60 // w, {name})),
{level}_s AS (SELECT *, cap * (w_all - w_before) <= (b - cap_before) * w AS sat FROM {level}_o),
{level}_r AS (SELECT *, b - sum(CASE WHEN sat THEN cap ELSE 0 END) OVER ({part}) AS rb, sum(CASE WHEN sat THEN 0 ELSE w END) OVER ({part}) AS rw FROM {level}_s),
{level}_f AS (SELECT *, CASE WHEN sat THEN cap ELSE rb * w // rw END AS a, CASE WHEN sat THEN -1 ELSE rb * w % rw END AS frac FROM {level}_r),
{level} AS (SELECT {cols}, (a + CASE WHEN NOT sat AND row_number() OVER ({part} ORDER BY frac DESC, {name}) <= rb - sum(CASE WHEN sat THEN 0 ELSE a END) OVER ({part}) THEN 1 ELSE 0 END)::HUGEINT AS b FROM {level}_f)"""


#: DuckDB SQL of the registered query: six tenths of all words, two epochs, seed 17, the weights of the registry.
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce('dom' || (nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '')::BIGINT % 4), 'other') AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens FROM documents),
k AS (SELECT *, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM d),
tokens AS (SELECT domain, l, s, sum(n_tokens)::HUGEINT AS t FROM k GROUP BY ALL),
root AS (SELECT sum(t) * 6 // 10 AS b FROM tokens),{_shares("dom", "root", "", "domain", "CASE domain WHEN 'dom0' THEN 4 WHEN 'dom1' THEN 3 WHEN 'dom2' THEN 2 ELSE 1 END")},{_shares("lng", "dom", "domain", "l", "CASE l WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},{_shares("leaf", "lng", "domain, l", "s", "1")},
p AS (SELECT domain, l, s, (b // t)::BIGINT AS whole, (b % t)::BIGINT AS rest FROM leaf JOIN tokens USING (domain, l, s) WHERE b > 0),
r AS (SELECT k.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY substr(md5('17:' || whole || ':' || doc_id), 1, 16), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN p USING (domain, l, s)),
ends AS (SELECT domain, l, s, min(upto) AS edge FROM r WHERE rest > 0 AND upto >= rest GROUP BY ALL),
x AS (SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, n_tokens, n_tokens AS take_tokens FROM (SELECT *, unnest(range(whole)) AS e FROM r)
UNION ALL SELECT doc_id, domain, lang, source, whole::INTEGER, n_tokens, least(n_tokens, rest - upto + n_tokens)::BIGINT FROM r JOIN ends USING (domain, l, s) WHERE rest > 0 AND (upto < edge OR upto = edge AND n_tokens > 0))
SELECT * FROM x
"""
