"""corpusloom: a Spark-native engine for corpora of quoted evidence."""

from __future__ import annotations

__version__ = "0.1.0"
