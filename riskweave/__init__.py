"""riskweave: cohort risk analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) that runs on the cluster; drivers only see metric rows.
"""

__version__ = "0.1.0"
