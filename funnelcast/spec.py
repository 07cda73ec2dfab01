"""The funnel specification every operator is parameterised by.

Operators never hard-code stage names; they read them from a :class:`FunnelSpec`
so the same code serves any ordered funnel (the default is the seven-stage
exchange funnel, but the daily ``events`` panel uses event types as stages).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from funnelcast.functions import vocab


@dataclass(frozen=True)
class FunnelSpec:
    stages: tuple = vocab.FUNNEL_STAGES
    labels: dict = field(default_factory=lambda: dict(vocab.STAGE_LABELS))
    target: str = "APP"
    realized: str = "RE"
    completed: str = "CO"
    diagnostics: tuple = ()
    default_entity: str = "MC"  # entity of cells that name none
    share_product: str = "GV"  # product whose share of the target is a feature
    low_quantile: float = 0.25
    high_quantile: float = 0.75

    @property
    def first(self) -> str:
        return self.stages[0]

    @property
    def end_stage(self) -> str:
        """Stage used for end-to-end efficiency (realized if present, else last)."""
        return self.realized if self.realized in self.stages else self.stages[-1]

    @property
    def value_columns(self) -> tuple:
        return tuple(self.stages) + tuple(self.diagnostics)

    def label(self, stage: str) -> str:
        return self.labels.get(stage, stage)


DEFAULT_SPEC = FunnelSpec()
