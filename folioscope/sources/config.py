"""Engine settings in a JSON file that only its owner can read; the token is never shown."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass


@dataclass
class EngineConfig:
    email: str = ""
    url: str = ""
    token: str = ""
    repo_url: str = ""

    def __post_init__(self):
        for name in ("url", "repo_url"):
            value = getattr(self, name)
            if value and not value.startswith(("http://", "https://")):
                raise ValueError(f"{name} must start with http:// or https://")

    def __repr__(self) -> str:
        return f"EngineConfig(email={self.email!r}, url={self.url!r}, repo_url={self.repo_url!r}, token={'SECRET' if self.token else ''!r})"

    def save(self, path: str) -> None:
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            json.dump(asdict(self), f)

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))
