"""Acquisition, lifetime-value, retention and subscription analytics on Spark."""

from growthgrain.catalog import MARKETING_QUERIES, SUBSCRIPTION_QUERIES
from growthgrain.plans.frames import GrowthFrames

__all__ = ["GrowthFrames", "MARKETING_QUERIES", "SUBSCRIPTION_QUERIES"]
