"""contactlake: contact data from tables of web pages, as Spark DataFrame jobs."""

from contactlake.settings import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
