"""Settings of the control link from environment variables, read once on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from contrail.functions import control


def setting(env: Mapping[str, str], name: str, default):
    """A variable as the type of its default; unset, empty and no number: the default. Whole numbers drop a fraction."""
    said = env.get(name) or ""
    if isinstance(default, str):
        return said or default
    try:
        return type(default)(float(said))
    except (ValueError, OverflowError):
        return default


@dataclass(frozen=True)
class Settings:
    """Seconds, but for the task and the number of steps."""

    task: str = "作战模拟"
    reset_after: float = control.RESET_AFTER
    refresh: float = 10.0
    horizon: float = 3.0
    hold: float = control.HOLD
    max_steps: int = control.MAX_STEPS
    max_total: float = control.MAX_TOTAL

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(**{field: setting(env, name, getattr(cls, field)) for field, name in VARIABLES.items()})


#: The variable of each setting.
VARIABLES = {
    "task": "SYSTEM_TASK_DEFAULT",
    "reset_after": "RESET_TIME_THRESHOLD",
    "refresh": "PLANNER_REFRESH_INTERVAL_S",
    "horizon": "EXECUTOR_TARGET_HORIZON_S",
    "hold": "EXECUTOR_DEFAULT_HOLD_S",
    "max_steps": "EXECUTOR_MAX_SEQUENCE_STEPS",
    "max_total": "EXECUTOR_MAX_SEQUENCE_TOTAL_S",
}
