"""Seriatim: quality measures for generated multivariate series, as Spark DataFrame transformations."""
