"""Spark-native analytics for conversational memory.

Tables (timeline, memories, identities, imports, graphs, vectors, access
rules) are DataFrames; every operator takes and returns DataFrames and leaves
the physical plan to Catalyst and AQE.
"""

__version__ = "0.1.0"
