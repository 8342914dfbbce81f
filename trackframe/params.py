"""Defaults of the windows, rules and scales. Fixed values of the data contract."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    history: int = 25
    future: int = 15
    stride: int = 2
    min_players: int = 7
    ball_fraction: float = 0.95
    player_factor: float = 1.0
    ball_factor: float = 2.0
    player_speed: float = 12.0
    ball_speed: float = 50.0
    version: int = 2

    @property
    def slots(self) -> int:
        return self.history + 1 + self.future

    @classmethod
    def of(cls, text: str) -> Params:
        """Settings of a TOML document; a name that isn't one, or a value of another type, is an error."""
        found = tomllib.loads(text)
        known = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        for name, value in found.items():
            if name not in known or isinstance(value, bool) or not isinstance(value, (known[name], int) if known[name] is float else known[name]):
                raise ValueError(f"bad setting {name}")
        return cls(**found)


DEFAULTS = Params()
