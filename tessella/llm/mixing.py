"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents are reduced to cells (source, lang, topic) with their token counts. Raking scales the cells' masses to the
target shares of each dimension in turn. A cell's sampling probability is its mass over its tokens, scaled so
that the expected tokens meet the budget with no probability above one; every document is then drawn by the
hash of its id.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.frames import cut

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of raking: so many at least, then more until the marginals are met within TOLERANCE of all mass, at most MOST_ROUNDS.
ROUNDS = 8
MOST_ROUNDS = 64
TOLERANCE = 1e-3
#: Steps that fill the budget: so many at least, then more until it is met within TOLERANCE or every cell is full, at most MOST_FILLS.
FILLS = 6
MOST_FILLS = 64
POWER = 0.5
SHARE = 0.5
SEED = "mix-1"
SMALL = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def topic() -> Column:
    """The kind of a whole text by its characters: empty, symbols, numbers, lists (short lines) or prose."""
    n = F.length("text")
    count = lambda pattern: F.regexp_count(F.col("text"), F.lit(pattern))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(20 * count(r"[#*$%&|<>]") > n, "symbols").when(10 * count("[0-9]") > n, "numbers").when(80 * (count("\n") + 1) > n, "lists").otherwise("prose")


def measured(docs: DataFrame) -> DataFrame:
    """The documents' dimensions and tokens (words); a null source or lang is the value '(none)', a null text has no token."""
    label = lambda c: F.coalesce(F.col(c), F.lit("(none)"))
    tokens = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"__source": label("source"), "__lang": label("lang"), "__topic": topic(), "__tokens": tokens})


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells (source, lang, topic, t) with `mass`: shares that fit the targets after raking over the dimensions in turn.

    Raking stops after ROUNDS rounds if the marginals are met within TOLERANCE, else it goes on; marginals that are still not met
    after MOST_ROUNDS, as cells without tokens can make targets impossible, are told by a warning with the residual.
    Without targets for a dimension its shares go by the token counts to the power POWER. Targets are renormalised over
    the values that have tokens. At most SMALL cells are handled in one partition, where raking needs no shuffle; more of them
    stay distributed, summed by each dimension's values.
    """
    cells = cells.where("t > 0")
    if cells.count() <= SMALL:
        cells = cells.coalesce(1)
    fits = cells.withColumn("mass", F.col("t").cast("double"))
    for dim in DIMENSIONS:
        given = (targets or {}).get(dim)
        table = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]) if given else None
        share = F.coalesce(table[F.col(dim)], F.lit(0.0)) if given else F.pow(F.sum("t").cast("double"), F.lit(POWER))
        total = cells.groupBy(dim).agg(share.alias("x") if not given else F.first(share).alias("x")).agg(F.sum("x")).first()[0] or 1.0
        over = F.pow(F.sum("t").over(W.partitionBy(dim)).cast("double"), F.lit(POWER)) if not given else share
        fits = fits.withColumn(f"to_{dim}", over / F.lit(total))
    fits = cut(fits)
    for turn in range(MOST_ROUNDS):
        for dim in DIMENSIONS:
            held = F.sum("mass").over(W.partitionBy(dim))
            fits = fits.withColumn("mass", F.when(held > 0, F.col("mass") * F.col(f"to_{dim}") / held).otherwise(0.0))
        if turn % 4 == 3:
            fits = cut(fits)
        if turn + 1 >= ROUNDS and turn % 4 == 3 and residual(fits) <= TOLERANCE:
            break
    else:
        warnings.warn(f"rake: marginals are off by {residual(fits):.3g} of the mass after {MOST_ROUNDS} rounds", stacklevel=2)
    return fits.select(*DIMENSIONS, "t", "mass")


def residual(fits: DataFrame) -> float:
    """The largest gap between a value's mass and its target (to_source, to_lang, to_topic), in shares of all mass."""
    gaps = [fits.groupBy(dim).agg(F.abs(F.sum("mass") - F.first(f"to_{dim}")).alias("gap")).agg(F.max("gap").alias("gap")) for dim in DIMENSIONS]
    return max((g[0] or 0.0 for frame in gaps for g in frame.collect()), default=0.0)


def calibrated(fits: DataFrame, share: float = SHARE) -> DataFrame:
    """Cells with `probability`: least(1, c * mass / t), c filling the budget of share * tokens.

    A budget that is not met within TOLERANCE after MOST_FILLS steps, as cells without mass can make it, is told by a warning.
    """
    fits = cut(fits)
    total = fits.agg(F.sum("t")).first()[0] or 0
    budget, c = share * total, 0.0
    for turn in range(MOST_FILLS + 1):
        full = F.lit(c) * F.col("mass") >= F.col("t")
        held, free = fits.agg(F.sum(F.when(full, F.col("t")).otherwise(0)).cast("double"), F.sum(F.when(full, 0.0).otherwise(F.col("mass")))).first()
        expected = (held or 0.0) + c * (free or 0.0)
        if not free or free <= 0 or turn >= FILLS and abs(expected - budget) <= TOLERANCE * budget:
            break
        if turn < MOST_FILLS:
            c = (budget - held) / free
    if total and abs(expected - budget) > TOLERANCE * budget:
        warnings.warn(f"calibrated: {expected:.6g} expected tokens for a budget of {budget:.6g}", stacklevel=2)
    return fits.withColumn("probability", F.round(F.least(F.lit(1.0), F.lit(c) * F.col("mass") / F.col("t")), 9)).withColumn("weight", F.round(F.col("mass") / F.col("t") * F.lit(float(total)), 9))


def drawn(doc_id: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE) -> DataFrame:
    """The documents with __source, __lang, __topic, __tokens, __weight, __probability and __sampled.

    Documents without tokens have probability 0. Repeated rows are drawn alike. Rows are summed to cells before any shuffle,
    so a hot source is one cell's row from each task; cells are joined back by broadcast if they were counted to at
    most SMALL, else by a shuffle in which hot cells are split. Documents may have columns of any name without a leading `__`.
    """
    known = measured(docs)
    cells = cut(known.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__tokens").alias("t")))
    found = cut(calibrated(rake(cells, targets), share))
    found = F.broadcast(found) if found.count() <= SMALL else found
    found = found.select(*[F.col(d).alias(f"__to_{d}") for d in DIMENSIONS], F.col("probability").alias("__probability"), F.col("weight").alias("__weight"))
    joined = known.join(found, [F.col(f"__{d}") == F.col(f"__to_{d}") for d in DIMENSIONS], "left").drop(*[f"__to_{d}" for d in DIMENSIONS])
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("__probability", "__weight")})
    return filled.withColumn("__sampled", drawn("doc_id") < F.col("__probability"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE) -> DataFrame:
    """The drawn documents, with their own columns."""
    return mix(docs, targets, share).where("__sampled").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: its cell, tokens, weight, probability and whether it is drawn."""
    narrow = mix(docs.select("doc_id", "text", "source", "lang"))
    return narrow.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("source", "lang", "topic")], F.col("__tokens").alias("n_tokens"), *[F.col(f"__{c}").alias(c) for c in ("weight", "probability", "sampled")])


def oracle() -> str:
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    parts = [f"""m AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN 20 * {count('[#*$%&|<>]')} > length(text) THEN 'symbols'
      WHEN 10 * {count('[0-9]')} > length(text) THEN 'numbers' WHEN 80 * ({count(chr(92) + 'n')} + 1) > length(text) THEN 'lists' ELSE 'prose' END AS topic,
    CAST(coalesce({count(WORD)}, 0) AS BIGINT) AS n_tokens
  FROM documents)""", "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS t FROM m GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for d in DIMENSIONS:
        parts.append(f"to_{d} AS (SELECT {d}, x / sum(x) OVER () AS goal FROM (SELECT {d}, pow(CAST(sum(t) AS DOUBLE), {POWER}) AS x FROM c GROUP BY {d}))")
    parts.append("w0 AS (SELECT c.*, CAST(t AS DOUBLE) AS mass FROM c)")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(f"w{n + 1} AS (SELECT source, lang, topic, t, mass * goal / sum(mass) OVER (PARTITION BY {d}) AS mass FROM w{n} JOIN to_{d} USING ({d}))")
            n += 1
    parts.append(f"k0 AS (SELECT {SHARE} * sum(t) / sum(mass) AS c FROM w{n})")
    for i in range(FILLS - 1):
        parts.append(f"k{i + 1} AS (SELECT ({SHARE} * sum(t) - sum(CASE WHEN c * mass >= t THEN t ELSE 0 END)) / sum(CASE WHEN c * mass >= t THEN 0.0 ELSE mass END) AS c FROM w{n}, k{i} )")
    parts.append(f"p AS (SELECT source, lang, topic, round(least(1.0, c * mass / t), 9) AS probability, round(mass / t * (SELECT sum(t) FROM w{n}), 9) AS weight FROM w{n}, k{FILLS - 1})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT m.doc_id, m.source, m.lang, m.topic, m.n_tokens, coalesce(p.weight, 0.0) AS weight, coalesce(p.probability, 0.0) AS probability,
  CAST(('0x' || substr(md5(m.doc_id || ':{SEED}'), 1, 8)) AS BIGINT) / 4294967296.0 < coalesce(p.probability, 0.0) AS sampled
FROM m LEFT JOIN p USING (source, lang, topic)
"""
