"""offerlab: marketing-decision analytics as Spark DataFrame plans.

Customer features, segments, recommendations, logged-bandit evaluation,
policy routing, offer resolution, retrieval and ROI reporting, all written
as DataFrame / Spark SQL / Spark ML / Structured Streaming operations so
that every customer and every logged round is processed in one plan.
"""

from offerlab.config import Params, DEFAULT_PARAMS

__all__ = ["Params", "DEFAULT_PARAMS"]
