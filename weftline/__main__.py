"""The commands: graph, candidates, detect and score. External aligners are not called; their output files are inputs.

python -m weftline graph GFF GENOME -o REF
python -m weftline candidates READS_GAF READS REF GENOME -o OUT    writes OUT/clustered and, to be aligned, OUT/consensus_fasta
python -m weftline detect CONSENSUS_GAF CONSENSUS_SAM REF -o OUT [--library LIBRARY]    reads OUT/clustered, writes OUT/report
python -m weftline score REPORT TRUTH -o OUT [--tolerance N]    writes OUT/matches and OUT/accuracy, and prints the latter
Paths are Spark's; on a cluster all executors must share them. GENOME and READS are opened by pyarrow.

candidates aligns the reads of possible fusions once more, to their genes' sequences, which it writes to OUT/total_reference: with an aligner of
its own, or, with --hits PAF, taking what another aligner found there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import report
from .params import FusionParams
from .plans import run
from .sources import sequence_files, text

#: Option letters, their parameter and what it says.
OPTIONS = [
    ("-s", "min_supporting_reads", "reads that a fusion needs"),
    ("-l", "min_block_len", "length that a read's records must exceed"),
    ("-g", "max_gap_length", "largest gap between a read's two genes"),
    ("-c", "min_consensus_length", "length of either half of a consensus"),
    ("-d", "bp_cluster_distance", "largest distance within a breakpoint cluster"),
    ("-O", "max_gap_one_alignment", "largest gap if one gene is hit again"),
    ("-T", "max_gap_two_alignments", "largest gap if both genes are hit again"),
    ("-M", "skip_chr_m", "leave out reads on chrM"),
    ("-P", "only_protein_coding", "keep only protein-coding genes"),
]


def flag(value: str) -> bool:
    if value.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return value.lower() == "true"


def parser() -> argparse.ArgumentParser:
    out, default = argparse.ArgumentParser(prog="weftline"), FusionParams()
    commands = out.add_subparsers(dest="command", required=True)
    for name, files, folder in (("graph", ["gff", "genome"], "./graph_ref"), ("candidates", ["gaf", "reads", "ref", "genome"], "./result"), ("detect", ["gaf", "sam", "ref"], "./result"), ("score", ["report", "truth"], "./result")):
        c = commands.add_parser(name)
        for f in files:
            c.add_argument(f)
        c.add_argument("-o", "--output_dir", default=folder)
        for letter, field, says in OPTIONS if name in ("candidates", "detect") else ():
            value = getattr(default, field)
            c.add_argument(letter, f"--{field}", type=flag if isinstance(value, bool) else int, default=value, help=f"{says} (default {value})")
        if name in ("candidates", "detect"):
            c.add_argument("--strict_support", action="store_true", help="also drop pairs with too few reads before they are clustered")
    commands.choices["candidates"].add_argument("--hits", help="alignments of the reads to OUT/total_reference, in PAF, in place of the own second alignment")
    commands.choices["detect"].add_argument("--library", help="pairs of genes with their tags; without it no pair is known to be normal")
    commands.choices["score"].add_argument("--tolerance", type=int, default=100, help="largest distance of either breakpoint (default 100)")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    folder, lines = args.output_dir.rstrip("/"), lambda path: text.lines(spark, path)
    if args.command == "graph":
        index = f"{folder}/genome_index"
        sequence_files.write_index(spark, args.genome, index)
        made = run.build_graph(lines(args.gff), sequence_files.fasta_pieces(spark, args.genome, index), folder)
        for name, rows in (("only_pc_gfa", made["gfa"].where("is_pc")), ("comprehensive_gfa", made["gfa"])):
            rows.where("kind <> 'P'").orderBy("seqid", "gene_uid", "line").select("line").write.mode("overwrite").text(f"{folder}/{name}")
        text.gene_lines(made["genes"]).write.mode("overwrite").text(f"{folder}/gene_pos")
        return
    if args.command == "score":
        calls, truth = text.reported(lines(args.report)), text.truth_set(spark, args.truth)
        named = report.matched(calls, truth, args.tolerance).join(truth.withColumnRenamed("id", "truth"), "truth").join(calls.withColumnRenamed("id", "call"), "call")
        named.drop("call", "truth").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/matches")
        run.written(report.accuracy(calls, truth, args.tolerance), folder, "accuracy").show(truncate=False)
        return
    params = FusionParams(strict_support=args.strict_support, **{field: getattr(args, field) for _, field, _ in OPTIONS})
    ref = args.ref.rstrip("/")
    genes = text.gene_table(spark, f"{ref}/gene_pos")
    if args.command == "candidates":
        sequences = sequence_files.reads(spark, args.reads)
        pieces = sequence_files.fasta_pieces(spark, args.genome, f"{ref}/genome_index")
        hits = text.paf(lines(args.hits)) if args.hits else run.second_alignment(sequences, pieces, genes, folder, params)
        found = run.candidates(lines(args.gaf), genes, folder, hits, params)
        run.consensus_fasta(found, sequences, folder, params).write.mode("overwrite").text(f"{folder}/consensus_fasta")
    else:
        library = text.annotation_library(lines(args.library)) if args.library else None
        rows = run.detect(spark.read.parquet(f"{folder}/clustered"), genes, library, lines(args.gaf), lines(args.sam), folder, params)
        report.report_lines(rows).write.mode("overwrite").text(f"{folder}/report")


if __name__ == "__main__":
    main()
