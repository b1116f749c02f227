"""Small files that people read: rare-class JSON, debug CSVs, and the Markdown report that only grows."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import report
from tessella.sources.datasets import STREET_CLASSES, VIDEO_CLASSES

HEADING = "# Runs\n"
#: Class names by data set, where they are fixed.
CLASS_NAMES = {"cityscapes": STREET_CLASSES, "camvid": VIDEO_CLASSES}


def class_names(dataset: str) -> tuple[str, ...] | None:
    return CLASS_NAMES.get(dataset)


def save_rare_classes(path: str | Path, dataset: str, counts: DataFrame, k: int) -> dict:
    """Write the k rarest classes of (class_id, n) counts, one row a class, with the counts and shares of all; returns what is written."""
    rows = [(r.class_id, r.n) for r in counts.orderBy("class_id").collect()]
    total = sum(n for _, n in rows) or 1
    ids = [c for c, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:k]]
    names = class_names(dataset)
    out = {"dataset": dataset, "k": k, "rare_class_ids": ids, "rare_class_names": [names[i] for i in ids] if names else None, "pixel_counts": [n for _, n in rows], "pixel_freq": [n / total for _, n in rows]}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2))
    return out


def save_csv(rows: DataFrame, path: str) -> None:
    """A debug table as CSV with a header; arrays and maps become JSON text."""
    plain = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*plain).write.mode("overwrite").csv(path, header=True)


def lines_of(rows: DataFrame, columns: list[str]) -> list[str]:
    """A frame of text columns as Markdown table lines, made by Spark."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("–")) for c in columns]), F.lit(" |"))
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *(r[0] for r in rows.select(cells).collect())]


def family_rows(runs: DataFrame) -> DataFrame:
    """The table of one section: a family's keys with seeds, metrics in percent and retention, as text."""
    table = report.families(runs).join(report.retention(runs).select("family", *report.KEY, "ref_family", "retention_pct"), ["family", *report.KEY], "left")
    text = lambda mean, std: report.mean_std_text(F.col(mean), F.col(std)).alias(mean.removesuffix("_mean"))
    shown = table.orderBy(F.desc("ratio"), "lr", "epochs")
    return shown.select("family", F.format_string("%s", "ratio").alias("ratio"), F.format_string("%.0e", "lr").alias("lr"), "epochs", "seeds", text("miou_mean", "miou_std"), text("rare_mean", "rare_std"), F.format_string("%.1f", "retention_pct").alias("retention %"))


def append_report(path: str | Path, runs: DataFrame, ledger: DataFrame | None = None, include: str | None = None, exclude: str | None = None, protected: tuple[str | Path, ...] = ()) -> list[str]:
    """Append a section for each family with finished runs that the report does not link yet; what stands there is never changed.

    Sections are numbered on and come in the order of the families' first new runs. Returns the families. A protected path is refused.
    """
    path = Path(path)
    if path.resolve() in {Path(p).resolve() for p in protected}:
        raise ValueError(f"{path} is protected")
    old = path.read_text() if path.exists() else HEADING
    done = report.finished(runs).where("skip_reason IS NULL").drop("skip_reason") if "state" in runs.columns else runs
    new = report.unreported(done, old, include, exclude)
    spark = runs.sparkSession
    number = report.next_number(spark.createDataFrame([(old,)], "text string")).first()[0]
    order = [r.family for r in report.sections(new).orderBy("section").collect()]
    out = []
    for place, family in enumerate(order):
        own = done.where(F.col("family") == family)
        pool = own.unionByName(done.where((F.col("method") == "full") & (F.col("family") != family)))
        table = lines_of(family_rows(pool).where(F.col("family") == family), ["ratio", "lr", "epochs", "seeds", "miou", "rare", "retention %"])
        fresh = new.where(F.col("family") == family)
        if ledger is not None:
            fresh = report.with_ledger(fresh, ledger, {"notes": "notes"})
        link = F.concat(F.lit("- ["), "name", F.lit("](https://runs.example/runs/"), "id", F.lit(")"), F.when(F.col("notes").isNotNull(), F.concat(F.lit(": "), "notes")).otherwise("") if ledger is not None else F.lit(""))
        links = [r[0] for r in report.in_order(fresh).orderBy("place").select(link).collect()]
        out.append("\n".join([f"## Experiment {number + place}: {family}", "", *table, "", *links, ""]))
    if out:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(old.rstrip("\n") + "\n\n" + "\n".join(out))
    return order


def overview(path: str | Path, runs: DataFrame, ledger: DataFrame | None = None, dataset: str | None = None, rare: tuple[int, ...] = (), baseline: str = "random", metrics: tuple[str, ...] = ("miou", "rare_miou")) -> None:
    """Write the comparison page anew: a table of methods against the baseline for each metric, by ratio, and classes by method where the ledger holds their IoUs.

    Deltas are in points; + and - mark those outside the baseline's band. A class table has the rare classes, and others that a method moves. The page is a few rows a method.
    """
    done = report.finished(runs).where("skip_reason IS NULL").drop("skip_reason") if "state" in runs.columns else runs
    spark, out = runs.sparkSession, ["# Overview", ""]
    for metric in metrics:
        cells = report.deltas(done, baseline, metric)
        ratios = [r.ratio for r in cells.select("ratio").distinct().orderBy("ratio").collect()]
        mark = F.when(F.col("mark") > 0, " +").when(F.col("mark") < 0, " -").otherwise("")
        at = [F.max(F.when(F.col("ratio") == r, F.concat(F.format_string("%+.2f", "delta"), mark))).alias(f"{r:g}") for r in ratios]
        table = cells.groupBy("dataset", "model", "method").agg(*at, F.count_if(F.col("mark") == 1).alias("wins"), F.count_if(F.col("mark") == -1).alias("losses"), F.format_string("%+.2f", F.avg("delta")).alias("mean"))
        out += [f"## {metric} against {baseline}", "", *lines_of(table.orderBy("dataset", "model", "method"), ["dataset", "model", "method", *(f"{r:g}" for r in ratios), "wins", "losses", "mean"]), ""]
    if ledger is not None:
        classes = report.per_class(report.latest_ledger(ledger).withColumnRenamed("selection_method", "method"), baseline)
        shown = report.movers(classes, list(rare)).select("class_id").union(spark.createDataFrame([(int(c),) for c in rare], "class_id int")).distinct()
        names = class_names(dataset) if dataset else None
        named = spark.createDataFrame([(i, n) for i, n in enumerate(names or ())], "class_id int, name string")
        methods = [r.method for r in classes.select("method").distinct().orderBy("method").collect()]
        value = F.concat(F.format_string("%.2f", 100 * F.col("iou")), F.when(F.col("method") != baseline, F.coalesce(F.concat(F.lit(" ("), F.format_string("%+.2f", 100 * F.col("delta")), F.lit(")")), F.lit(""))).otherwise(""))
        wide = classes.join(shown, "class_id").join(named, "class_id", "left").groupBy("class_id", "name").pivot("method", methods).agg(F.first(value))
        table = wide.withColumn("rare", F.when(F.col("class_id").isin(list(rare)), "yes").otherwise("")).withColumn("class", F.coalesce("name", F.concat(F.lit("class "), F.col("class_id").cast("string"))))
        out += ["## Classes", "", *lines_of(table.orderBy("class_id"), ["class", "rare", *methods]), ""]
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(out))
