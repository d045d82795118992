"""Jobs from the command line: ``python -m veritrail.cli JOB ...``.

normalize, export, extract, ingest, score, align, verify, index, query, questions and decisions.
Every job reads folders and writes new ones, so a failed job leaves its inputs as they were.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ALIGNABLE_TYPES, AlignConfig, RetrievalConfig, TrustConfig
from .operators import align, graph, retrieve, trust
from .plans import jobs
from .sources import tables
from .sources.models import embed, hashed_ngrams, http_chat
from .sources.taxonomy import taxonomy


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veritrail")
    sub = p.add_subparsers(dest="job", required=True)

    def add(name: str, *required: str, **optional) -> None:
        s = sub.add_parser(name)
        for r in required:
            s.add_argument(f"--{r}", required=True)
        for k, v in optional.items():
            flag = f"--{k.replace('_', '-')}"
            s.add_argument(flag, action="store_true") if v is False else s.add_argument(flag, default=v, type=type(v) if v is not None else str)

    add("normalize", "out", "run-at", events=None, cves=None)
    add("extract", "data", out=None, event=None, cve=None, chat_url=None, chat_model="")
    add("ingest", "facts", "graph", "out", limit=0, check=False)
    add("export", "table", "key", "out")
    add("score", "graph", "out", taxonomy=None, force=False, sample=0)
    add("align", "graph", "out", log=None, type=None, threshold=AlignConfig().threshold, names_only=False, planes=0)
    add("verify", "graph")
    add("index", "graph", "out")
    add("query", "graph", "index", "text", top_k=RetrievalConfig().top_k, depth=RetrievalConfig().depth, chat_url=None, chat_model="")
    add("questions", "graph", "index", top_k=RetrievalConfig().top_k, depth=RetrievalConfig().depth, chat_url=None, chat_model="")
    add("decisions", "log", last=20)
    return p


def _show(df: DataFrame, n: int = 50) -> None:
    """A small report; never more than n rows."""
    for row in df.limit(n).collect():
        print(", ".join(f"{k}: {v}" for k, v in row.asDict().items()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("veritrail").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    chat = http_chat(a.chat_url, a.chat_model) if getattr(a, "chat_url", None) else None
    if a.job == "normalize":
        jobs.normalize(spark, a.events, a.cves, a.out, a.run_at)
    elif a.job == "extract" and (a.event or a.cve):
        one = jobs.extract_one(spark, a.data, "events" if a.event else "cves", a.event or a.cve, chat)
        print("\n".join(one.toJSON().collect()) or "no such record")  # one row
        if a.out:
            tables.write_table(one, a.out)
    elif a.job == "extract":
        if not a.out:
            raise SystemExit("extract: --out is required for all records")
        _show(jobs.extract_all(spark, a.data, a.out, chat))
    elif a.job == "ingest":
        facts = spark.read.parquet(a.facts)
        jobs.ingest(spark, facts.orderBy("id").limit(a.limit) if a.limit else facts, a.graph, a.out, F.current_timestamp(), a.check)
        nodes, edges = tables.read_graph(spark, a.out)
        for df in (graph.count_by(nodes, "type"), graph.count_by(edges, "rel_type"), graph.dated(edges)):
            _show(df)
    elif a.job == "export":
        print(f"files: {tables.write_files(spark.read.parquet(a.table), a.key, a.out)}")
    elif a.job == "decisions":
        _show(tables.last_decisions(spark, a.log, a.last))
    else:
        nodes, edges = tables.read_graph(spark, a.graph)
        if a.job == "score":
            terms = [r.term for r in taxonomy(spark, a.taxonomy).select("term").collect()]  # a fixed public vocabulary
            config = TrustConfig.from_env()
            rows = edges if not a.force or "trust" not in edges.columns else trust.reset(edges)
            tables.write_graph(nodes, trust.score_missing(rows, nodes, terms, config, a.sample or None), a.out)
            _show(trust.run_summary(spark.read.parquet(f"{a.out}/edges")))
        elif a.job == "align":
            text = F.concat(F.col("type"), F.lit(": "), F.col("name")).alias("text")
            vectors = None if a.names_only else embed(nodes.select("name", "type", text), "text", hashed_ngrams())
            aligned, decisions = align.align(nodes, edges, vectors, AlignConfig(threshold=a.threshold, planes=a.planes or None), types=(a.type,) if a.type else ALIGNABLE_TYPES)
            tables.write_graph(aligned, edges, a.out)
            if a.log:
                tables.log_decisions(decisions, a.log)
            done = spark.read.parquet(f"{a.out}/nodes")
            for df in (align.global_counts(done), align.by_type(done), align.top_clusters(done)):
                _show(df)
        elif a.job == "verify":
            _show(trust.verify_summary(edges))
            _show(trust.by_relation(edges))
        elif a.job == "index":
            retrieve.build_index(nodes, a.out)
        elif a.job == "questions":
            config = RetrievalConfig(top_k=a.top_k, depth=a.depth)
            for got in jobs.verify(spark, nodes, edges, retrieve.load_index(spark, a.index), chat=chat, config=config):
                print(f"{got['question']}\nentities: {len(got['entities'])}, {', '.join(f'{k}: {v}' for k, v in got['stats'].items() if k != 'sources')}\n{got['answer'] or ''}")
        elif a.job == "query":
            config = RetrievalConfig(top_k=a.top_k, depth=a.depth)
            got = jobs.answer(spark, a.text, nodes, edges, retrieve.load_index(spark, a.index), chat=chat, config=config)
            print(got["context"] if got["answer"] is None else got["answer"])


if __name__ == "__main__":
    main()
