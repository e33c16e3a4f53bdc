"""tidemark: time-aligned text and event analytics on Spark.

Every public operator takes DataFrames or Columns and returns them; nothing here runs a job unless
its docstring says so. The subpackage ``llm`` holds the training-data operators and is optional:
no other module imports it.
"""
