"""plumbline: a PySpark-native engine for semi-structured text records.

Pure ``DataFrame -> DataFrame`` functions grouped by operator family. The
optional subpackage ``plumbline.llm`` holds the operators for training data;
nothing else in the library imports it.
"""

__version__ = "0.1.0"
