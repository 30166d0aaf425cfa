"""The queries. Each is a function from DataFrames to a DataFrame and runs no job.

``ltv_regression`` is the one exception: fitting a model runs a job.
"""
