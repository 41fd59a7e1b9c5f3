"""Consumer credit-risk analytics on Spark DataFrames.

Sub-packages
------------
functions   column expressions (parsing, binning, scorecard, reasons)
operators   DataFrame -> DataFrame computations
sources     readers, layer sinks, feature store, logs
plans       end-to-end jobs composed from the operators
streaming   the decision stream on Structured Streaming
"""
