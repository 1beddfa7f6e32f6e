"""repolith: repository and activity analytics on PySpark.

Everything is expressed over DataFrames.  The subpackage ``llm`` holds the
operators for preparing training text; nothing else imports it.
"""

__version__ = "0.1.0"
