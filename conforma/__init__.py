"""Spark-native comparison of ensembles."""

__version__ = "0.1.0"
from .session import EnsembleSession
from .sources.trajectory import load_trajectories

__all__ = ["EnsembleSession", "load_trajectories"]
