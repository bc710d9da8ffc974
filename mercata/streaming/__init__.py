"""Incremental readouts over event streams.

The reference is batch only; this package runs the same A/B readout over a
growing stream of click events with Structured Streaming, so an experiment
dashboard stays current without rescanning history.
"""

from mercata.streaming.experiment_stream import arm_counts_stream, latest_arm_summary, start_arm_summary

__all__ = ["arm_counts_stream", "start_arm_summary"]
