from .datasets import TripDatasets

__all__ = ["TripDatasets"]
