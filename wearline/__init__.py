"""wearline — Spark-native run-to-failure telemetry analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from native Spark SQL expressions, windows, joins and
aggregates. Python workers appear only where Spark has no native form
(within-partition prefix sums, kNN distance blocks, stateful streaming).
"""

__version__ = "0.1.0"
