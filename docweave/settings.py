"""Settings of a run from environment variables named DOCWEAVE_…, over the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from docweave.types import DEFAULTS, Thresholds

TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    router_model: str = "micro"
    cheap_model: str = "fast"
    strong_model: str = "strong"
    cascade: bool = True
    reflection: bool = True
    cache: bool = True
    output: str = "out"
    limits: Thresholds = DEFAULTS

    @property
    def chain(self) -> tuple[str, ...]:
        """Models in the order in which they are asked."""
        return (self.cheap_model, self.strong_model) if self.cascade and self.cheap_model != self.strong_model else (self.strong_model,)


def load(env: dict[str, str] | None = None) -> Settings:
    """DOCWEAVE_CASCADE=off, DOCWEAVE_TOP_K=8 and so on; names are those of Settings and Thresholds."""
    env = os.environ if env is None else env

    def read(cls, default):
        found = {}
        for f in fields(cls):
            text = env.get(f"DOCWEAVE_{f.name.upper()}")
            if text is not None and f.name != "limits":
                kind = type(getattr(default, f.name))
                found[f.name] = text.strip().lower() in TRUE if kind is bool else kind(text)
        return found

    return Settings(**read(Settings, Settings()), limits=Thresholds(**{**DEFAULTS.__dict__, **read(Thresholds, DEFAULTS)}))
