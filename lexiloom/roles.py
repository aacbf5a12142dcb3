"""Column roles, task types and the contract between roles and a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Role and task names a dataset configuration may use.
DELETE = "Delete"
TARGET = "y"
NUMERICAL = "Numerical"
SPECIAL = "Special"
ONE_HOT = "OneHotEncoderDense"
ONE_HOT_DROP_LAST = "OneHotEncoderDense-1"
TARGET_ENCODED = "TargetEncoder"
TASKS = ("regression", "binary", "multiclass")

CATEGORICAL_ROLES = (ONE_HOT, "OneHotEncoder", SPECIAL, ONE_HOT_DROP_LAST)


@dataclass(frozen=True)
class ColumnRoles:
    """Which column plays which part in a learning task."""

    roles: Mapping[str, str]
    task: str
    dirtiness: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.task not in TASKS:
            raise ValueError(f"unknown task {self.task!r}, known are {TASKS}")
        if sum(role == TARGET for role in self.roles.values()) != 1:
            raise ValueError("exactly one column must have the role 'y'")

    @property
    def target(self) -> str:
        return next(c for c, role in self.roles.items() if role == TARGET)

    @property
    def features(self) -> list[str]:
        return [c for c, role in self.roles.items() if role not in (TARGET, DELETE)]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.features if self.roles[c] in CATEGORICAL_ROLES]

    @property
    def special(self) -> list[str]:
        return [c for c in self.features if self.roles[c] == SPECIAL]

    def check(self, df: DataFrame) -> None:
        """Fail before any job runs when a role names a missing column."""
        missing = [c for c in self.roles if c not in df.columns]
        if missing:
            raise ValueError(f"columns named by roles are missing: {missing}")

    def select(self, df: DataFrame) -> DataFrame:
        """Features and target only, each field tagged with its role."""
        self.check(df)
        out = df.select(*self.features, self.target)
        for name in out.columns:
            out = out.withMetadata(name, {**out.schema[name].metadata, "role": self.roles[name]})
        return out
