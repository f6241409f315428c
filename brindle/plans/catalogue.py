"""Every query by name, and its DuckDB SQL."""

from __future__ import annotations

from . import adaptive_queries, batch_queries, bits_queries, codec_queries, coder_queries, extension_queries, file_queries, frame_queries, likelihood_queries, listing_queries, loss_queries, lpc_queries, metric_queries, moment_queries, nested_queries, recurrence_queries, report_queries, sampling_queries, sequence_queries, signal_queries, source_queries, study_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

FLAGSHIP = "rice_eval_mono"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
