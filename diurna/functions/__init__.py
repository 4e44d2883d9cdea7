from diurna.functions import arrays, clock, hashing, numeric

__all__ = ["arrays", "clock", "hashing", "numeric"]
