"""Marketplace order analytics as Spark DataFrame operators.

Sources and sinks live in ``agora.sources``, column helpers in
``agora.functions``, the operators in ``agora.operators``, join and plan
helpers in ``agora.plans``, incremental loading in ``agora.streaming``.
"""

from agora.model import Tables
from agora.session import build_session, checkpoint_dir

__all__ = ["Tables", "build_session", "checkpoint_dir"]
