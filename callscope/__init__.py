"""callscope: tool-call evaluation and schema-corpus analytics as Spark jobs.

Every public function takes DataFrames and column names and returns a DataFrame, so
jobs compose with ``df.transform`` and Catalyst sees one declarative plan.
"""
__version__ = "0.1.0"
