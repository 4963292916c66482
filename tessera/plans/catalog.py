"""Imports every module that registers queries."""

from __future__ import annotations

from tessera.plans import graphs, index, maintenance, retrieval, search, understanding

MODULES = [graphs, index, maintenance, retrieval, search, understanding]
