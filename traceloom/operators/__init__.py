"""Distributed operators that Spark SQL has no single expression for."""

from traceloom.operators.asof import asof_join
from traceloom.operators.chains import ancestor_chains, ancestor_pairs, chain_digests, closure, nearest_marked
from traceloom.operators.histogram import log_histogram
from traceloom.operators.ordered import ordered_scan
from traceloom.operators.overlap import overlap_join, overlap_totals
from traceloom.operators.slices import QuantileSlices, SliceDirectory, WidthSlices, join_groups, quantile_slices, slice_directory

__all__ = [
    "QuantileSlices",
    "SliceDirectory",
    "WidthSlices",
    "ancestor_chains",
    "ancestor_pairs",
    "asof_join",
    "chain_digests",
    "closure",
    "join_groups",
    "log_histogram",
    "nearest_marked",
    "ordered_scan",
    "overlap_join",
    "overlap_totals",
    "quantile_slices",
    "slice_directory",
]
