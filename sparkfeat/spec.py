"""Feature roles are declared, never guessed from column names or dtypes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSpec:
    id: str
    label: str | None = None
    split: str | None = None  # boolean column: True = unlabelled / test side
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict)  # extra name -> family

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def family(self, name: str) -> str:
        if name in self.roles:
            return self.roles[name]
        if name in self.numeric:
            return "numeric"
        if name in self.categorical:
            return "categorical"
        return "other"

    def require(self, columns, *names) -> None:
        missing = [n for n in names if n not in columns]
        if missing:
            raise KeyError(f"columns not in table: {missing}")
