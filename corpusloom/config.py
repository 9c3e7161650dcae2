"""Where a user's sources, model and policy lie: by environment variables, which must name absolute paths."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from .operators import service


@dataclass(frozen=True)
class Config:
    """Paths; null where the environment names none."""

    source_root: str | None = None
    book_path: str | None = None
    model_path: str | None = None
    policy_path: str | None = None

    @classmethod
    def read(cls, environ: Mapping[str, str] | None = None) -> Config:
        own = dict(os.environ if environ is None else environ)
        return cls(*(service.configured(own, f"CORPUSLOOM_{name}") for name in ("SOURCE_ROOT", "BOOK_PATH", "MODEL_PATH", "POLICY_PATH")))
