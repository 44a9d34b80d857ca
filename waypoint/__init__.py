"""waypoint: loyalty-programme unit modelling as Spark DataFrame jobs.

Every operator is a lazy ``(DataFrame(s), params) -> DataFrame`` function
built from ``pyspark.sql.functions``; the job modules in ``waypoint.plans``
wire them together.
"""

from waypoint.params import ModelParams

__all__ = ["ModelParams"]
