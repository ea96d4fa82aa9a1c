"""All registered queries; importing this module fills the registry."""

from . import q_decode, q_events, q_graph, q_jobs, q_model, q_shots, q_stats, q_stream
from .q_events import failed_shots
from .registry import callables, oracles

__all__ = ["callables", "failed_shots", "oracles"]
