"""Command line: score prediction files against a gold file, cut texts into chunks, make a gold file of annotation pages, show a report."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkwell.operators import chunking, evaluation
from inkwell.sources import paged, tables


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    texts = tables.read_texts(spark, args.source_root) if args.source_root else None
    gold = tables.read_gold(spark, args.gold, texts)
    schemas = tables.read_schemas(spark, args.schemas) if args.schemas else None
    report = evaluation.evaluate(gold, tables.read_predictions(spark, args.predictions), schemas)
    counts, metrics = report.counts.filter("episode_no is null").first(), report.metrics().filter("episode_no is null").first()
    head = spark.read.schema(tables.GOLD).json(args.gold, multiLine=True).select("name", "datasetVersion", F.size("episodes").alias("n")).first()
    summary = tables.machine_summary(counts, metrics, {"analysisModel": args.model, "semanticJudgeEnabled": False}, {"name": head["name"], "version": head["datasetVersion"], "episodeCount": head["n"]})
    if args.output:
        Path(args.output).write_text(json.dumps(summary, ensure_ascii=False, indent=2), encoding="utf-8")
    if args.markdown:
        Path(args.markdown).write_text(tables.markdown(summary), encoding="utf-8")
    return summary


def run_report(spark: SparkSession, args: argparse.Namespace) -> str:
    """A report file as a page, and without anything that is derived from a source text as machine output."""
    report = json.loads(Path(args.report).read_text(encoding="utf-8"))
    summary = {k: report.get(k, {}) for k in ("run", "dataset", "metrics", "counts")}
    page = tables.markdown(summary)
    for path, text in ((args.output, page), (args.machine_output, json.dumps(summary, ensure_ascii=False, indent=2))):
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(text, encoding="utf-8")
    return page


def run_chunk(spark: SparkSession, args: argparse.Namespace) -> None:
    chunking.chunks(tables.read_texts(spark, args.texts), "file").write.mode("overwrite").parquet(args.output)


def run_gold(spark: SparkSession, args: argparse.Namespace) -> None:
    """A gold file of annotation pages, from JSON lines or from the paged source, written episode by episode."""
    if args.paged:
        paged.register(spark)
        pages = spark.read.format("paged").option("path", args.pages).load()
        pages = paged.annotations(pages.filter(F.col("episode_no").isin([float(e) for e in args.episode])) if args.episode else pages)
    else:
        pages = spark.read.schema(tables.PAGES).json(args.pages)
    rows = tables.parse_annotations(pages)
    episodes = tables.settled(tables.gold_from_annotations(rows.filter(F.col("episode_no").isin(args.episode)) if args.episode else rows))
    if episodes.isEmpty():
        raise ValueError("no annotation row matches the episodes")
    version = args.version or tables.snapshot_version(episodes, args.name)
    with open(args.output, "w", encoding="utf-8") as out:
        out.write(f'{{"datasetVersion": {json.dumps(version)}, "name": {json.dumps(args.name, ensure_ascii=False)}, "episodes": [')
        for i, r in enumerate(episodes.orderBy("episodeNo").select(F.to_json(F.struct("*")).alias("t")).toLocalIterator()):
            out.write(("," if i else "") + "\n" + r["t"])
        out.write("\n]}\n")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkwell", description=__doc__)
    sub = top.add_subparsers(required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("--gold", required=True)
    e.add_argument("--predictions", required=True, action="append")
    for name in ("--source-root", "--schemas", "--model", "--output", "--markdown"):
        e.add_argument(name)
    e.set_defaults(run=run_evaluate)
    c = sub.add_parser("chunk")
    c.add_argument("texts")
    c.add_argument("output")
    c.set_defaults(run=run_chunk)
    g = sub.add_parser("gold")
    g.add_argument("pages")
    g.add_argument("output")
    g.add_argument("--name", required=True)
    g.add_argument("--version")
    g.add_argument("--paged", action="store_true")
    g.add_argument("--episode", type=int, action="append")
    g.set_defaults(run=run_gold)
    r = sub.add_parser("report")
    r.add_argument("--report", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--machine-output")
    r.set_defaults(run=run_report)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    return args.run(spark or (None if args.run is run_report else SparkSession.builder.getOrCreate()), args)


if __name__ == "__main__":
    main()
