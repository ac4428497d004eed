"""The event log as a source: subscription, offsets, causal order, look-back, decoding and routing."""

from sluice.sources.events import ENVELOPE, above, between, decode, joint_look_back, look_back_bound, looked_back, offsets, present, read_log, route, stream_log, subscribe

__all__ = ["ENVELOPE", "above", "between", "decode", "joint_look_back", "look_back_bound", "looked_back", "offsets", "present", "read_log", "route", "stream_log", "subscribe"]
