"""Parameters and fixed values.

Everything the pipeline reads as a knob lives in :class:`Params`; the
defaults are the published defaults of the application being re-built.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's for equal results).
# ---------------------------------------------------------------------------

# Segment codes, in ladder order (first match wins).
SEGMENTS = ["loyal", "growth", "new", "regular", "churn_risk"]
DEFAULT_SEGMENT = "regular"

# Policy order used by the router; ties go to the earliest.
POLICY_ORDER = ["uplift", "contextual_bandit", "fusion", "rl_policy", "rule_engine"]

# Bandit-suite policy aliases (unknown -> contextual_bandit).
SUITE_ALIASES = {
    "bandit": "contextual_bandit",
    "contextual": "contextual_bandit",
    "contextual_bandit": "contextual_bandit",
    "uplift": "uplift",
    "fusion": "fusion",
    "hybrid": "fusion",
    "uplift_bandit": "fusion",
}

# Router aliases (unknown -> rule_engine, "auto" kept).
ROUTER_ALIASES = {
    "auto": "auto",
    "rule": "rule_engine",
    "rules": "rule_engine",
    "rule_engine": "rule_engine",
    "rl": "rl_policy",
    "rl_policy": "rl_policy",
}

# Rule-engine segment -> action.
RULE_SEGMENT_ACTION = {"loyal": 1, "growth": 0, "new": 2, "regular": 3, "churn_risk": 4}

# ROI segment multipliers (unknown -> 1.0).
SEGMENT_MULTIPLIER = {"loyal": 1.5, "growth": 1.3, "new": 1.2, "regular": 1.0, "churn_risk": 0.8}

# Event type -> logged action index, for the events table used as a bandit log.
EVENT_ACTIONS = ["click", "error", "purchase", "signup", "view"]

# Category label map for the test `part` table (p_type -> label); PROMO is
# deliberately absent so that some products carry a NULL category.
CATEGORY_LABELS = {
    "ECONOMY": "economy",
    "LARGE": "large",
    "MEDIUM": "medium",
    "SMALL": "small",
    "STANDARD": "standard",
}

# Chunking separators, tried in this order; the first one present wins.
CHUNK_SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ".", " "]


@dataclass(frozen=True)
class SegmentThresholds:
    """Segment ladder: (recency <, frequency cmp, monetary >) per rung."""

    loyal_recency: float = 30
    loyal_frequency: float = 2  # frequency > value
    loyal_monetary: float = 200
    growth_recency: float = 60
    growth_frequency: float = 1  # frequency > value
    growth_monetary: float = 100
    new_recency: float = 90
    new_frequency: float = 1  # frequency == value
    regular_recency: float = 180
    regular_monetary: float = 50


@dataclass(frozen=True)
class Params:
    # data
    completed_status: str = "F"
    # segmentation
    n_clusters: int = 5
    kmeans_seed: int = 42
    kmeans_restarts: int = 10
    thresholds: SegmentThresholds = field(default_factory=SegmentThresholds)
    # recommendation
    n_recommend: int = 3
    bestsellers_per_category: int = 5
    global_bestsellers: int = 20
    price_band_low: float = 0.5
    price_band_high: float = 1.5
    # bandit
    n_actions: int = 5
    seed: int = 42
    min_pscore: float = 0.03
    alpha: float = 0.6
    uplift_weight: float = 0.45
    bandit_weight: float = 0.55
    ridge_reg: float = 1.0
    min_samples: int = 20
    use_ipw: bool = True
    # router
    low_pscore: float = 0.08
    high_complexity: float = 0.95
    churn_recency: float = 90.0
    force_rule_on_missing_context: bool = True
    min_confidence: float = 0.45
    force_rule_pscore: float = 0.02
    router_min_samples: int = 200
    router_seed: int = 42
    router_trees: int = 240
    router_depth: int = 10
    router_min_leaf: int = 8
    feedback_enabled: bool = True
    feedback_metric: str = "DR"
    feedback_lr: float = 0.15
    feedback_decay: float = 0.02
    feedback_clip: float = 0.25
    feedback_ema: float = 0.2
    temperature: float = 1.0
    # retrieval
    chunk_size: int = 512
    chunk_overlap: int = 100
    top_k: int = 3
    nlist: int = 100
    nprobe: int = 10
    # conversion model
    hot_products: int = 300
    negatives_per_customer: int = 3
    train_fraction: float = 0.8
    gbt_rounds: int = 150
    gbt_step: float = 0.05
    gbt_depth: int = 6
    sms_cost: float = 0.1
    freight_ratio: float = 0.1

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT_PARAMS = Params()
