"""Settings of a run, with the defaults of the documented configuration."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class PairColumns:
    """Names of the pair table's columns; the right document's carry a suffix."""

    suffix: str = "_2"
    key: tuple[str, str, str] = ("stack_id", "doc_id", "sub_doc_id")
    label: str = "label"
    legacy: str = "legacy_rule"
    lar: str = "lar"
    import_time: str = "import_time"
    reimbursement: str = "reimbursement"
    paid_out: str = "paid_out"

    @property
    def key_2(self) -> tuple[str, ...]:
        return tuple(c + self.suffix for c in self.key)


@dataclass(frozen=True)
class Filters:
    exclude_lar_prefix: str = "3"
    exclude_lar_value: str = "141"
    train_start: datetime | None = None
    train_end: datetime | None = None
    #: Document 1 in [start, end), document 2 in [start_2, end_2).
    window: tuple[datetime, datetime, datetime, datetime] | None = None
    #: End of the historic window of document 2.
    historic_end: datetime | None = None


@dataclass(frozen=True)
class Learning:
    max_predicates_per_rule: int = 2
    max_candidate_rules: int = 1000
    min_recall: float = 0.99
    min_new_tp: int = 5


@dataclass(frozen=True)
class Config:
    predicates: dict = field(default_factory=dict)
    filters: Filters = field(default_factory=Filters)
    learning: Learning = field(default_factory=Learning)
    columns: PairColumns = field(default_factory=PairColumns)
    #: Share of positives after downsampling of unlabelled rows; None keeps all.
    positive_rate: float | None = 0.1
    test_split: float | None = None
    review_cost: float = 20.0
    min_reimbursement_threshold: float = 0.0
    sample_size: int = 500
    seed: int = 42

    def __post_init__(self) -> None:
        if self.positive_rate is not None and not 0 < self.positive_rate <= 1:
            raise ValueError("positive_rate must be in (0, 1] or None")
        if self.test_split is not None and not 0 <= self.test_split < 1:
            raise ValueError("test_split must be in [0, 1) or None")
        if self.learning.max_predicates_per_rule < 1 or self.learning.max_candidate_rules < 1:
            raise ValueError("learning limits must be positive")
