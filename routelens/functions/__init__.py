from . import temporal, geo, encodings, arrays

__all__ = ["temporal", "geo", "encodings", "arrays"]
