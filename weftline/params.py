"""All parameters of fusion detection, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FusionParams:
    min_supporting_reads: int = 2
    min_block_len: int = 30
    max_gap_length: int = 200
    min_consensus_length: int = 30
    bp_cluster_distance: int = 30
    max_gap_one_alignment: int = 30
    max_gap_two_alignments: int = 15
    min_gap: int = -15
    gene_extension: int = 100
    min_soft_clip: int = 30
    overlap_reject: int = 15
    merge_gap_floor: int = -5
    three_gene_gap: int = 15
    snap_tolerance: int = 20
    near_window: int = 500
    exon_snap_graph: int = 30
    exon_snap_genome: int = 100
    exon_boundary_distance: int = 50
    far_distance: int = 100_000
    middle_distance: int = 50_000
    skip_chr_m: bool = True
    only_protein_coding: bool = True
    strict_support: bool = False
    graph_k: int = 12
    graph_w: int = 1
