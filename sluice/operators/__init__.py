"""Flows: DataFrames whose rows carry a signed multiplicity."""

from sluice.operators.flow import Flow, Grouped, Probe
from sluice.operators.weights import MULT, consolidate, expand, negate, spare, union, weighted

__all__ = ["MULT", "Flow", "Grouped", "Probe", "consolidate", "expand", "negate", "spare", "union", "weighted"]
