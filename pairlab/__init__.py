"""pairlab: Spark-native operators for building and scoring program-edit datasets.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame ->
DataFrame operators by pipeline), ``sources`` (readers and writers),
``streaming`` (row-wise operators on streams) and ``plans`` (composed jobs,
fixture views and the checked query registry).
"""

__version__ = "0.1.0"
