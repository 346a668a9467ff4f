"""Auditable data preparation on Spark DataFrames.

Sub-packages
------------
``sources``    readers, writers and JSON recovery
``functions``  column expressions (text, scalar, guarded statistics)
``operators``  DataFrame -> DataFrame cleaning, profiling, sampling and scoring
``plans``      cleaning plans: fit/transform model, policy tables, audit, search
``streaming``  running a fitted plan over a stream
"""

from tidyloom.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
