"""proofline: prove on Spark that tables say what they should."""

from .session import cut, scratch_path, session, shared_dir

__all__ = ["cut", "scratch_path", "session", "shared_dir"]
