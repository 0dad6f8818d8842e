"""Identity-audit analytics on Spark DataFrames.

Public functions take and return ``DataFrame`` and compose with
``df.transform(...)``.  Sub-packages: ``sources`` (reading), ``functions``
(column helpers), ``operators`` (normalise, filter, load, alert, report),
``plans`` (the query library) and ``streaming``.
"""

from accesslens.plans.registry import catalogue, run

__all__ = ["catalogue", "run"]
