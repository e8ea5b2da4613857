"""Biosignal and silent-speech analytics as Spark DataFrame operators."""

from subvox.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
