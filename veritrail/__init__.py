"""Checks whether an apparent edge in dated observations is real, as Spark plans."""
