"""foldwise: tabular feature preparation, cross-fitting and ensembling on Spark.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame
operators), ``sources`` (readers, writers, stand-in inputs), ``plans``
(cross-fitting, learners, stage graph, preprocessor), ``streaming``
(Structured Streaming operators). ``catalog`` registers the queries.
"""

__version__ = "0.1.0"
