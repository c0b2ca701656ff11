"""PySpark-native operators for multimodal utterance corpora."""

__version__ = "0.1.0"
