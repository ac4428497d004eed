"""Whole plans: the batch stepper and the example queries."""

from sluice.plans.machine import Machine

__all__ = ["Machine"]
