"""Stateful verbs on streams, as keyed processors, and the runner that keeps SQL tables equal to flows."""

from sluice.streaming.processors import counted, extreme, first_and_sum, joined, monotonic_max, present, reduced, representative
from sluice.streaming.runner import Export, catch_up
from sluice.streaming.steps import stream_deltas

__all__ = ["Export", "catch_up", "counted", "extreme", "first_and_sum", "joined", "monotonic_max", "present", "reduced", "representative", "stream_deltas"]
