"""Era ranges for training, validation and test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default era ranges (half open) and the gap between training and validation.
EMBARGO = 8
TRAIN_ERA_0 = 1
TEST_ERA_0 = 1133
TEST_ERA_1 = 1176
TRAIN_ERA_1 = TEST_ERA_0 - EMBARGO
VALIDATION_ERA_0 = TEST_ERA_0
VALIDATION_ERA_1 = TEST_ERA_1
FALLBACK_RANGE = (1, 2)


@dataclass(frozen=True)
class EraRange:
    """Half-open range ``[start, stop)``."""

    start: int
    stop: int

    def contains(self, era: str | Column = "era") -> Column:
        col = F.col(era) if isinstance(era, str) else era
        return (col >= F.lit(self.start)) & (col < F.lit(self.stop))


@dataclass(frozen=True)
class Splits:
    """Ranges of the three splits. By default validation and test are the same eras."""

    train: EraRange = EraRange(TRAIN_ERA_0, TRAIN_ERA_1)
    validation: EraRange = EraRange(VALIDATION_ERA_0, VALIDATION_ERA_1)
    test: EraRange = EraRange(TEST_ERA_0, TEST_ERA_1)

    def label(self, era: str = "era") -> Column:
        """Split name of a row: the first range that holds it, else null (also for the embargo gap)."""
        return (
            F.when(self.train.contains(era), F.lit("train"))
            .when(self.validation.contains(era), F.lit("validation"))
            .when(self.test.contains(era), F.lit("test"))
        )

    def labels(self, era: str = "era") -> Column:
        """Array of every split name that holds the row; splits may overlap."""
        parts = {"train": self.train, "validation": self.validation, "test": self.test}
        return F.array_compact(F.array(*[F.when(r.contains(era), F.lit(n)) for n, r in parts.items()]))


def resolve_range(era_0: int | None, era_1: int | None) -> EraRange:
    """Requested range; if either bound is missing both fall back to ``[1, 2)``."""
    if era_0 is None or era_1 is None:
        return EraRange(*FALLBACK_RANGE)
    return EraRange(era_0, era_1)


def walk_forward(outer: EraRange, n_validation: int, embargo: int = EMBARGO) -> tuple[EraRange, EraRange]:
    """Split the last ``n_validation`` eras off a range and leave a gap before them."""
    cut = outer.stop - n_validation
    return EraRange(outer.start, cut - embargo), EraRange(cut, outer.stop)
