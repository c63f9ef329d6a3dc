"""Settings of a run: where tables live, which environment, what to process."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

LAYERS = ("landing", "bronze", "silver", "gold", "ops")
#: Environments, and whether the monthly schedule is on in them.
ENVIRONMENTS = {"dev": None, "uat": False, "prod": True}


@dataclass(frozen=True)
class Settings:
    """root: workspace folder; every environment has its own tree under it."""

    root: str
    env: str = "dev"
    run_month: str = ""
    full_refresh: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if self.env not in ENVIRONMENTS:
            raise ValueError(f"unknown environment {self.env!r}")

    @property
    def base(self) -> str:
        return f"{self.root.rstrip('/')}/{self.env}"

    @property
    def landing(self) -> str:
        return f"{self.base}/landing/yellow"

    @property
    def landing_zones(self) -> str:
        return f"{self.base}/landing/zones"

    @property
    def checkpoints(self) -> str:
        return f"{self.base}/checkpoints"

    @property
    def tables(self) -> str:
        return f"{self.base}/tables"


def parse_flag(text: str | None) -> bool:
    """True for "true" in any case; False for anything else, also for none."""
    return (text or "").strip().lower() == "true"
