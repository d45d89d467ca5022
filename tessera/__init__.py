"""tessera: corpus → tokens → packed blocks → scores → run analytics, as Spark plans."""

__version__ = "0.1.0"
