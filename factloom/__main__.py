"""Command line: python -m factloom {embed,evaluate,ask} ...

Tables are parquet folders: chunks, vectors, facts anchors and retrieval cases as the operators
document them.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from factloom.operators.embedding import completeness_gate, embed_pending, hash_encoder
from factloom.operators.gates import enforce
from factloom.operators.metrics import report_lines
from factloom.operators.vector_index import write_vector_index
from factloom.plans import retrieval_eval
from factloom.plans.answering import answer
from factloom.session import build_session
from factloom.sources.files import read_cases, relevant_pairs


def _embed(spark, args) -> None:
    """Encode chunks that have no vector, into a new folder; optionally build the cell index."""
    chunks, encoder = spark.read.parquet(args.chunks), hash_encoder(args.dimension)
    stored = spark.read.parquet(args.vectors) if args.vectors else chunks.limit(0).select("chunk_id", F.lit(None).cast("array<double>").alias("embedding"))
    embed_pending(chunks, stored, encoder, "chunk_id", args.limit).write.mode("errorifexists").parquet(args.out)
    done = spark.read.parquet(args.out)
    if args.limit is None:
        enforce(completeness_gate(chunks.select("chunk_id").join(done, "chunk_id", "left"), "chunk_id"))
    if args.cells:
        write_vector_index(done, f"{args.out}_index", args.cells, "chunk_id")


def _evaluate(spark, args) -> None:
    """Recall and MRR of the four arms over labelled cases."""
    chunks, vectors = spark.read.parquet(args.chunks), spark.read.parquet(args.vectors)
    cases = read_cases(spark, args.cases)
    queries = cases.select("query_id", "query").withColumn("vector", hash_encoder(args.dimension)(F.col("query")))
    hits = retrieval_eval.arms(chunks.select("chunk_id", "text"), vectors.select("chunk_id", "embedding"), queries, analyser=args.analyser)
    scored = retrieval_eval.evaluate(hits, chunks.select("chunk_id", "accession_no", "item_section"), relevant_pairs(cases), queries)
    report_lines(scored).show(truncate=False)


def _ask(spark, args) -> None:
    """Answer questions given on the command line."""
    asked = spark.createDataFrame(list(enumerate(args.question)), "request_id int, question string")
    answer(asked, spark.read.parquet(args.chunks), spark.read.parquet(args.anchors)).show(truncate=False, vertical=True)


def main() -> None:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(required=True)
    embed = commands.add_parser("embed", help=_embed.__doc__)
    embed.add_argument("--vectors")
    embed.add_argument("--out", required=True)
    embed.add_argument("--limit", type=int)
    embed.add_argument("--cells", type=int)
    evaluate = commands.add_parser("evaluate", help=_evaluate.__doc__)
    evaluate.add_argument("--vectors", required=True)
    evaluate.add_argument("--cases", required=True)
    evaluate.add_argument("--analyser", default="english", choices=["plain", "english"])
    ask = commands.add_parser("ask", help=_ask.__doc__)
    ask.add_argument("--anchors", required=True)
    ask.add_argument("question", nargs="+")
    for command, run in ((embed, _embed), (evaluate, _evaluate), (ask, _ask)):
        command.add_argument("--chunks", required=True)
        command.add_argument("--dimension", type=int, default=1024)
        command.set_defaults(run=run)
    args = parser.parse_args()
    start = time.time()
    args.run(build_session(), args)
    print(f"done in {time.time() - start:.1f} s")


if __name__ == "__main__":
    main()
