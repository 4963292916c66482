"""The folder that driver and executors share, as the library has it."""

from __future__ import annotations

from tessera.sources.scratch import scratch, shared_dir, stored

__all__ = ["scratch", "shared_dir", "stored"]
