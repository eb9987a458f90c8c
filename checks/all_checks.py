"""Imports every check module, which fills the registry."""

from . import chat_checks, cluster_checks, eval_checks, graph_checks, retrieve_checks, stream_checks, text_checks  # noqa: F401
from .registry import QUERIES, oracle  # noqa: F401
