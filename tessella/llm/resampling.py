"""Importance resampling towards a target: hashed n-gram gains, document weights and a Gumbel draw without replacement, in DataFrame functions.

The gain of a bucket is the log ratio of its share in the target texts over its share in the corpus. A document's weight is the sum of
the gains of its features; the highest sums of weight and Gumbel noise are a draw without replacement by those weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.frames import stored

BUCKETS = 10_000
NGRAMS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of digits, letters a to z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """The lower-cased (A to Z alone) words of a text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def features(found: Column | str, ngrams: int = NGRAMS) -> Column:
    """All runs of 1 to `ngrams` consecutive words of an array, joined by a space, repeats included."""
    found = F.col(found) if isinstance(found, str) else found

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (n - 1))
        return F.when(F.size(found) >= n, F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(found, *[of(n) for n in range(2, ngrams + 1)]) if ngrams > 1 else found


def bucket(feature: Column | str, buckets: int) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def counts(texts: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """(bucket, n) of a frame with text: features are exploded and counted in each task before the shuffle, which moves `buckets` rows a task at most."""
    each = texts.select(F.explode(features(words("text"), ngrams)).alias("f"))
    return each.groupBy(bucket("f", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(docs, ngrams, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(counts(target, ngrams, buckets).withColumnRenamed("n", "t"), "bucket", "left")
    # Two columns of at most `buckets` rows: their totals come from one window over that bounded table.
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    whole = W.partitionBy()
    rate = ((F.col("t") + 1.0) * (F.sum("s").over(whole) + float(buckets))) / ((F.col("s") + 1.0) * (F.sum("t").over(whole) + float(buckets)))
    return both.select("bucket", s.alias("s"), t.alias("t")).select("bucket", F.floor(1000.0 * F.ln(rate)).cast("long").alias("gain"))


def noise(doc_id: Column | str, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256('<seed>:<doc_id>')."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs, rows repeated under one id included.

    Features are exploded in the scan, joined with the gain table, which has `buckets` rows whatever the corpus, and summed by
    row: a task has all features of its rows, so its partial sums are whole and one narrow row a document is shuffled.
    """
    table = F.broadcast(stored(gains(docs, target, ngrams, buckets)))
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), words("text").alias("__words"))
    # A row without features stays, as explode_outer gives it one null.
    each = found.select("doc_id", "__row", F.size("__words").alias("__n"), F.explode_outer(features("__words", ngrams)).alias("__f"))
    joined = each.withColumn("bucket", bucket("__f", buckets)).join(table, "bucket", "left")
    sums = joined.groupBy("doc_id", "__row").agg(F.max("__n").cast("long").alias("n_words"), F.count("__f").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return sums.select("doc_id", "n_words", "n_features", "weight")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their 1-based rank: a range-partitioned sort, written, and the sizes of the partitions before added to each row's place in its own.

    The sort is written once, so ranks do not move when an executor is lost. The offsets are one row a partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = stored(sorted_rows.withColumn("__part", F.shiftright(at, 33).cast("int")).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    before = F.sum("__size").over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1))
    offsets = held.groupBy(F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__size")).select("__of", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = held.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return ranked.withColumn("rank", F.col("__before") + F.col("__at")).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, *, ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null where a row is not drawn.

    Of the N rows with an id and at least `least_words` words, floor(percent * N / 100) of the highest scores are drawn, ties to the
    smaller doc_id. A null or empty text has no features and weight 0; a row with a null id has a null score and is never
    drawn, though its words count. Rows repeated under one id are each weighed, and ranked one after the other. Other
    columns of docs and target are not looked at. Empty tables give no rows, an empty target the gains of no occurrence.
    """
    rows = stored(weights(docs, target, ngrams, buckets).withColumn("score", F.col("weight") + noise("doc_id", seed)))
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    n = rows.where(able).count()
    drawn = placed(rows.where(able), F.desc("score"), F.asc("doc_id"))
    rank = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    out = drawn.withColumn("rank", rank).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns: a semi-join of docs with the ranked ids. Rows repeated under a drawn id all stay."""
    held = resample(docs.select("doc_id", "text"), target.select("text"), **options).where("rank IS NOT NULL")
    return docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


#: CRC-32 by its table of 256 remainders (polynomial 0xEDB88320), word by word; the SQL twin has no built-in one.
CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END"
CRC_MACRO = f"""crc_bits AS (SELECT n, n::BIGINT AS c, 0 AS i FROM range(256) t(n)), crc_steps AS (SELECT n, c, i FROM (WITH RECURSIVE r AS (SELECT n, c, i FROM crc_bits UNION ALL SELECT n, {CRC_STEP}, i + 1 FROM r WHERE i < 8) SELECT * FROM r)),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE i = 8)"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes; crc_table must be joined in as `t`."""
    codes = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLE = f"""WITH {CRC_MACRO},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark),
x AS (SELECT doc_id, unnest(w) AS f FROM d), v AS (SELECT f, CAST({crc_sql('f')} % {BUCKETS} AS INTEGER) AS k FROM (SELECT DISTINCT f FROM (SELECT f FROM x UNION ALL SELECT f FROM b)), crc_table),
s AS (SELECT k, count(*) AS n FROM x JOIN v USING (f) GROUP BY k), u AS (SELECT k, count(*) AS n FROM b JOIN v USING (f) GROUP BY k),
g AS (SELECT k, CAST(floor(1000.0::DOUBLE * ln(((coalesce(u.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM u), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN u USING (k)),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM x JOIN v USING (f) JOIN g USING (k) GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(m.n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, ('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {PERCENT} * count(*) OVER () // 100 AS drawn FROM z WHERE n_features >= {LEAST_WORDS})
SELECT z.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM z LEFT JOIN o USING (doc_id)"""
