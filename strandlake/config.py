"""Options of the public operations, with the defaults that users of compressive search expect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CompressOptions:
    """map_seed_size is the k of the k-mer index; lengths are in bases, thresholds in percent."""

    gapped_window_size: int = 100
    map_seed_size: int = 10
    ext_seq_id_threshold: int = 50  # accepted, without effect
    min_match_len: int = 300
    max_kmer_freq: int = 500
    overlap: int = 100
    max_chunk_size: int = 10_000
    min_progress: int = 50
    consec_match_clump_size: int = 4
    window_ident_thresh: int = 85
    btwn_match_min_dist_check: int = 10
    max_consec_mismatch: int = 3
    procs: int = 0  # parallelism is Spark's
    notify_every: int = 1000  # progress is in Spark's UI

    def __post_init__(self) -> None:
        if not 1 <= self.map_seed_size <= 15:
            raise ValueError("map_seed_size must be from 1 to 15")
        if self.overlap >= self.max_chunk_size:
            raise ValueError("overlap must be less than max_chunk_size")


@dataclass(frozen=True)
class StoreOptions:
    """How a database lays out its tables, from its first addition on."""

    word_size: int = 11  # of the stored k-mers; searches with words of another size make theirs anew
    seed_buckets: int = 0  # folders of k-mers, a power of two; 0: by size
    pieces_per_part: int = 1 << 18  # coarse pieces in a folder

    def __post_init__(self) -> None:
        if not 1 <= self.word_size <= 31 or self.pieces_per_part < 1:
            raise ValueError("word_size must be from 1 to 31, pieces_per_part at least 1")
        if self.seed_buckets & (self.seed_buckets - 1) or self.seed_buckets > 4**self.word_size:
            raise ValueError("seed_buckets must be a power of two, and no more than there are k-mers")


@dataclass(frozen=True)
class SearchOptions:
    """coarse_evalue and fine_evalue bound the hits kept; pad is added on both sides of an expansion."""

    coarse_evalue: float = 1e-20
    fine_evalue: float = 1e-30
    pad: int = 50
    link_block_size: int = 30_000
    word_size: int = 11
    min_seeds: int = 3
    band: int = 32  # diagonals whose seeds count together
    karlin_k: float = 0.4  # the factor of e-values
    match: int = 1
    mismatch: int = -3
    gap: int = -3
    xdrop: int = 30  # an extension ends where its score is so far below its best
    mask: bool = True  # no seeds in stretches of low complexity; extensions go over them
    mask_window: int = 64
    mask_level: float = 2.0
    pooled: bool = False  # every query against every expansion, not only its own
    distinct_expansions: bool = True
    merged_expansions: bool = False  # one expansion where those of a query touch
    stored_seeds: bool = True  # False: k-mers that are asked for are made from the coarse pieces, for a database that is searched once
    load_coarse: bool = False  # keep the coarse tables in memory
    load_compressed: bool = False


@dataclass(frozen=True)
class BlatOptions(SearchOptions):
    """The variant for long queries with percent identity: coarse hits over max_target_span are skipped."""

    pad: int = 10
    min_identity: float = 80.0
    max_target_span: int = 1000
    chain_gap: int = 10_000  # hits of one alignment lie no further apart
    number_targets: bool = False
    show_offsets: bool = False
    complete_psl: bool = False
    half_open_hits: bool = False  # take t_end as inclusive, as some callers of the format do
