"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  ``register()`` gives the queries and the
oracle SQL that the driver entry adds when the subpackage is present.
"""
