"""A fluent dataflow API for analytics pipelines on PySpark."""

from rillworks.session import session
from rillworks.stream import RunResult, SinkHandle, Stream, run, source

__version__ = "0.1.0"
__all__ = ["RunResult", "SinkHandle", "Stream", "__version__", "run", "session", "source"]
