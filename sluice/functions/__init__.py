"""Column functions that the operators share."""

from sluice.functions.ordering import matches_json, ordered, tagged_json

__all__ = ["matches_json", "ordered", "tagged_json"]
