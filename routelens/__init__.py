"""routelens: trajectory analytics as Spark DataFrame plans.

Subpackages
-----------
sources    table loading, the derived trajectory fixture, dataset persistence
functions  column expressions (time, geometry, encodings, arrays)
operators  DataFrame -> DataFrame operators (motion, statistics, splits,
           sequences, nearest places, search, metrics, prompts, vectors)
plans      named derived datasets and task evaluations built from operators
streaming  the per-point features applied to a stream of points
"""

__all__ = ["session", "constants"]
