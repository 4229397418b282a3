"""Multichannel signal decomposition and spike-train analytics as Spark jobs."""
