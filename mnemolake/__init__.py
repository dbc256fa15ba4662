"""mnemolake: a PySpark-native engine for long-lived text memories.

Memories, concept links, graph edges, triples and beliefs are ordinary
DataFrames; every operator here maps DataFrames to DataFrames.
"""

__version__ = "0.1.0"
