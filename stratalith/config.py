"""Defaults and clamps of the retrieval, chunking, policy and budget settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Smallest and largest values; a setting outside is moved to the nearer bound (fixed values).
CLAMPS = {
    "parent_target_tokens": (64, None), "parent_max_tokens": (96, None), "child_target_tokens": (32, None), "child_max_tokens": (48, None), "child_overlap_tokens": (0, None),
    "child_top_k": (1, None), "child_union_limit": (1, None), "parent_eligible_limit": (1, None), "parent_select_limit": (1, None), "relative_score_window": (0, None),
    "context_pressure_ratio": (0.1, 0.95), "context_target_ratio": (0.05, 0.9), "semi_budget_ratio": (0.01, 0.8), "evidence_budget_ratio": (0.05, 0.45),
    "working_inactive_turns": (1, None), "semi_association_turns": (1, None), "semi_association_count": (1, None), "bank_association_count": (1, None), "bank_session_count": (1, None),
    "journal_compact_after": (10, None),
}


@dataclass(frozen=True)
class Config:
    parent_target_tokens: int = 2048
    parent_max_tokens: int = 3072
    child_target_tokens: int = 384
    child_max_tokens: int = 512
    child_overlap_tokens: int = 64
    child_top_k: int = 8
    child_union_limit: int = 32
    parent_eligible_limit: int = 16
    parent_select_limit: int = 6
    relative_score_window: float = 0.20
    evidence_quality_threshold: float = 0.80
    coverage_lexical_minimum: float = 0.35
    coverage_dense_minimum: float = 0.75
    coverage_dense_margin: float = 0.025
    lexical_guarantee: int = 4
    working_inactive_turns: int = 4
    semi_association_turns: int = 8
    semi_association_count: int = 2
    bank_association_count: int = 3
    bank_session_count: int = 2
    semi_inactive_turns: int = 12
    semi_inactive_hours: float = 24.0
    semi_activation_floor: float = -1.5
    semi_importance: float = 0.85
    semi_durability: float = 0.85
    bank_importance: float = 0.90
    bank_durability: float = 0.90
    context_pressure_ratio: float = 0.65
    context_target_ratio: float = 0.55
    semi_budget_ratio: float = 0.20
    evidence_budget_ratio: float = 0.45
    context_window: int = 128_000
    max_output_tokens: int = 8192
    journal_compact_after: int = 2000
    stopwords: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for f in fields(self):
            low, high = CLAMPS.get(f.name, (None, None))
            value = getattr(self, f.name)
            if low is not None and value < low:
                object.__setattr__(self, f.name, low)
            if high is not None and value > high:
                object.__setattr__(self, f.name, high)
        object.__setattr__(self, "parent_target_tokens", min(self.parent_target_tokens, self.parent_max_tokens))
        object.__setattr__(self, "child_target_tokens", min(self.child_target_tokens, self.child_max_tokens))
