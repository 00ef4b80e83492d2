"""leafmill: table cleaning and document structuring as Spark DataFrame transforms."""

from leafmill.session import checkpointed, get_session

__all__ = ["checkpointed", "get_session"]
