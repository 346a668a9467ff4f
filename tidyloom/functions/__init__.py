from tidyloom.functions import scalar, text

__all__ = ["scalar", "text"]
