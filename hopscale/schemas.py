"""Schemas of all tables of the engine."""

from __future__ import annotations

NODES = "node_id long, x double, y double"
EDGES = "src long, dst long, cost double"
ZONES = "zone long, zone_idx int"
LAYERS = "layer int, radius double, cutoff double"
REPS = "layer int, zone long, rep_idx int"
COSTS = "layer int, src long, dst long, cost double"
GROUPS = "layer int, zone long, rep long"
INTERACTIONS = "layer int, src long, dst long, value double, correction double, net double"
ACTIVITY = "zone long, value double"
