"""Settings of a walk program."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from fractions import Fraction


@dataclass(frozen=True)
class WalkConfig:
    walk_length: int = 20
    walks_per_vertex: int = 1
    p: Fraction = Fraction(1)
    q: Fraction = Fraction(1)
    alpha: Fraction = Fraction(1, 5)
    decay_factor: Fraction = Fraction(17, 20)
    seed: int = 42
    #: Steps between two tables of the frontier.
    segment: int = 5
    #: Up to that many walks from a list of starts fetch the lists that they need by id instead of reading the graph.
    on_demand_walks: int = 10_000
    #: An adjacency table of no more bytes is read whole all the same: that costs less than a job for each step.
    on_demand_bytes: int = 10 << 20
    #: A vertex with more neighbours is a hub: its list does not travel with the walks.
    hub_degree: int = 10_000

    @classmethod
    def from_settings(cls, settings: dict[str, str], **over) -> WalkConfig:
        """From the names of a settings file (``walk-length``); unknown names are left alone."""
        kinds = {f.name: f.type for f in fields(cls)}
        own = {k.replace("-", "_"): v for k, v in settings.items()}
        read = {k: int(own[k]) if kinds[k] == "int" else Fraction(own[k]) for k in kinds if k in own}
        return replace(cls(**read), **over)
