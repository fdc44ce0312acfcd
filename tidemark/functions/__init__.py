"""Scalar functions as SQL expressions that Spark inlines into whole-stage code."""
