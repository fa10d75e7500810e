"""quillspark: curation and ranked search of semi-structured document collections on PySpark."""

__version__ = "0.1.0"
