"""Slick detection, drift backtracking and vessel ranking as Spark DataFrame operators."""
