"""Tables that cut lineage, as the library stores them."""

from tidemark.sources.stored import discard, shared_dir
from tidemark.sources.stored import store as materialize

__all__ = ["discard", "materialize", "shared_dir"]
