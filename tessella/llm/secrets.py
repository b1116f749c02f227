"""Secret scans over versioned content with a blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds the findings of each
(blob, rule version) pair that was ever scanned; a scan reads only the texts of blobs that some rule version has not
seen, one text for each blob, and joins the findings back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.frames import bounded, empty, shared_folder, stored

#: rule_versions: the rules that a row has applied to its blob, as kind@version, comma-joined; a blob may have several rows.
LEDGER = "blob string, rule_versions string, spans array<struct<start:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """kind, version, pattern, least length of group `group`, and words of which a text must hold one (lower case)."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hints: tuple[str, ...] = ()
    fold: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds count.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, ("passw", "secret", "token", "api"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18, 0, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ("eyj",)),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{4,128}@", 0, 0, ("://",)),
)
RULES = BASE + MORE
#: Blobs with findings, some hundred bytes each, that are broadcast.
FOUND = 100_000
#: Scans of the query, each of them over its share of the versions with the ledger that the others have left.
INCREMENTS = 2


def scanner(rules: tuple[Rule, ...]) -> Callable[[str], list[tuple[int, int, str]]]:
    ready = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)).finditer) for r in rules]

    def scan(text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        found = []
        for order, (rule, matches) in enumerate(ready):
            if rule.hints and not any(h in low for h in rule.hints):
                continue
            for m in matches(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((m.start(), order, m.end(), rule.kind))
        return [(start, end, kind) for start, _, end, kind in sorted(found)]

    return scan


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of (blob, text, missing) rows, missing being the comma-joined rule versions to apply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans: dict[str, Callable] = {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            found = []
            for text, missing in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                if missing not in scans:
                    scans[missing] = scanner(tuple(r for r in rules if r.key in missing.split(",")))
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in scans[missing](text.as_py() or "")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], ["blob", "rule_versions", "spans"])

    return blobs.select("blob", "text", "missing").mapInArrow(run, LEDGER)


def scan(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, news): `findings` has a row (path, blob, spans) for each row of paths; `news` are the rows to append to the ledger.

    A null text is the empty blob. Repeated rows and copies share one blob, scanned once. A null path is kept; its
    text is scanned like others. Spans are ordered by start, then by the order of the rules. A ledger row of another
    rule version is left alone. The text is moved once, to the one task that scans its blob; hot blobs are reduced to one
    representative before any text moves, and findings meet their paths by broadcast or by a join of two plain shuffles.
    """
    spark = paths.sparkSession
    ledger = empty(spark, LEDGER) if ledger is None else ledger
    wanted = F.array(*[F.lit(r.key) for r in rules])
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    kinds = [r.kind for r in rules]
    held = paths.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    known = ledger.where(F.arrays_overlap(F.split("rule_versions", ","), wanted)).dropDuplicates(["blob", "rule_versions"])
    seen = known.groupBy("blob").agg(F.flatten(F.collect_set(F.split("rule_versions", ","))).alias("seen"))
    index = stored(held.select("path", "blob"))
    chosen = index.groupBy("blob").agg(F.min("path").alias("at")).join(seen, "blob", "left")
    missing = F.array_join(F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))), ",")
    chosen = chosen.select(F.col("blob").alias("chosen"), "at", missing.alias("missing")).where("missing <> ''")
    unseen = held.join(chosen.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("chosen"))).select("blob", "text", "missing")
    news = stored(scan_blobs(unseen, rules).dropDuplicates(["blob", "rule_versions"]))
    spans = known.unionByName(news).where(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    spans = spans.withColumn("spans", F.filter("spans", lambda s: s["kind"].isin(kinds)))
    ordered = F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kind:string>>")
    findings = index.join(bounded(stored(spans), FOUND), "blob", "left").select(F.col("path").alias(path_col), "blob", F.coalesce(ordered, none).alias("spans"))
    return findings, news


def scan_increments(paths: DataFrame, increments: int = INCREMENTS, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings of all paths, scanned as so many increments (by the hash of the path) against one ledger table.

    Each increment reads the ledger, scans the pairs of blob and rule version that are new, and appends them; so a blob that
    an earlier increment held is not scanned again. The ledger is a table in the shared folder.
    """
    spark, folder = paths.sparkSession, shared_folder(paths.sparkSession)
    empty(spark, LEDGER).write.parquet(folder)
    found = None
    for i in range(increments):
        own = paths.where(F.pmod(F.xxhash64(F.col(path_col)), F.lit(increments)) == i)
        findings, news = scan(own, spark.read.schema(LEDGER).parquet(folder), rules, path_col, text_col)
        if i + 1 < increments:
            news.write.mode("append").parquet(folder)
        found = findings if found is None else found.unionByName(findings)
    return found


def digest(findings: DataFrame, path_col: str = "doc_id") -> DataFrame:
    """The per-document columns: counts of base kinds, the digest of the base spans, and all spans as text."""
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return findings.select(path_col, *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute(text: str | None) -> str:
    """Base spans of one text by the plain definition, for tests."""
    found = []
    for order, (kind, pattern, group, least, flags) in enumerate((("assign", BASE[0].pattern, 2, 12, re.I | re.A), ("access", BASE[1].pattern, 0, 18, re.A), ("hex", "[0-9a-f]+", 0, 16, re.A))):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[group]) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest()
