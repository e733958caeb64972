"""corpusloom: link-aware corpus engineering on PySpark.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame transformations), ``plans``
(named queries), ``streaming`` (stateful context assembly).  Operators for
language-model training data live in their own sub-package, which nothing here
imports.
"""

__version__ = "0.1.0"
