"""Options of dependency discovery."""

from __future__ import annotations

from dataclasses import dataclass

STRATEGIES = ("auto", "cube", "group", "broadcast")
#: Bytes of coded rows up to which they are broadcast, where no other bound is named.
BROADCAST_BYTES = 256 << 20


@dataclass(frozen=True)
class FDConfig:
    """What to find, and how to look for it; only the first three options change the result.

    max_lhs_size: largest left-hand side, 0 or less for any.
    row_limit: rows that are read, 0 or less for all.
    null_equals_null: whether a null agrees with a null.
    strategy: ``cube`` (all partitions at once, few columns), ``group`` (one aggregation for each
        left-hand side), ``broadcast`` (dictionary codes on every executor), or ``auto``.
    candidates_per_job: candidates that one Spark job validates.
    validation_threshold: share of valid candidates under which sampling goes on.
    max_candidates: bound on stored candidates; beyond it the largest left-hand sides are given
        up and max_lhs_size is lowered (None: no bound).
    max_bytes: the same by the measured bytes of covers and agree sets that the driver holds.
    results: a folder to which a right-hand side's dependencies are appended as soon as they are final;
        a run that finds some there takes them as they are and goes on with the other ones.
    broadcast_bytes: size of coded rows up to which they are broadcast (None: BROADCAST_BYTES); beyond
        it ``auto`` and ``broadcast`` take the way of ``group``. A bound that is named is held: beyond
        it ``broadcast`` raises.
    pli_cache_prefix: attributes at the start of a left-hand side of which partitions are kept for
        other ones that start alike (0: none).
    pli_cache_bytes: size of the partitions that a task keeps.
    pli_cache_table_bytes: size on disk of the tables of prefixes that ``group`` keeps.
    """

    max_lhs_size: int = -1
    row_limit: int = -1
    null_equals_null: bool = True
    strategy: str = "auto"
    candidates_per_job: int = 4096
    sets_per_job: int = 30
    validation_threshold: float = 0.8
    max_candidates: int | None = None
    max_bytes: int | None = None
    results: str | None = None
    broadcast_bytes: int | None = None
    pli_cache_prefix: int = 3
    pli_cache_bytes: int = 256 << 20
    pli_cache_table_bytes: int = 16 << 30
    relation: str = "relation"

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}, not {self.strategy!r}")
        if not 0 <= self.validation_threshold <= 1:
            raise ValueError("validation_threshold is a share from 0 to 1")
        if min(self.pli_cache_prefix, self.pli_cache_bytes, self.pli_cache_table_bytes) < 0:
            raise ValueError("a cache has no negative size")
        if self.candidates_per_job < 1 or self.sets_per_job < 1:
            raise ValueError("a job has one candidate at least")

    @property
    def lhs_limit(self) -> int | None:
        return self.max_lhs_size if self.max_lhs_size > 0 else None
