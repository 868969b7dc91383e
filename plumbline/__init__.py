"""Business metrics over star and snowflake schemas on Spark."""

from plumbline.model import Model, ModelError, Relationship, Table
from plumbline.plans.compose import metric_slices, query

__all__ = ["Model", "ModelError", "Relationship", "Table", "metric_slices", "query"]
