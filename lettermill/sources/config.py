"""The settings file: JSON with the archives that were opened and the source of each."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

RECENT = 10


@dataclass
class Config:
    archives: list[str] = field(default_factory=list)
    sources: dict[str, dict[str, str]] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Config:
        """The settings; a missing file gives none. Unknown keys are an error."""
        file = Path(path)
        return Config(**json.loads(file.read_text(encoding="utf-8"))) if file.exists() else Config()

    def save(self, path: str) -> None:
        """Replace the file in one step."""
        new = Path(f"{path}.new")
        new.write_text(json.dumps(asdict(self), indent=2, sort_keys=True), encoding="utf-8")
        new.replace(path)

    def remember(self, archive: str) -> None:
        """Put an archive first among the recent ones."""
        self.archives = [archive, *(a for a in self.archives if a != archive)][:RECENT]
