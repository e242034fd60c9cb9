"""Evidence tables on Spark: DataFrame operators over corpora of parsed engineering documents."""

__version__ = "0.1.0"
