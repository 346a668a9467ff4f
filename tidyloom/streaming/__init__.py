from tidyloom.streaming.apply import clean_stream, dedup_stream, write_stream
from tidyloom.streaming.profile import last_profile, profile_stream

__all__ = ["clean_stream", "dedup_stream", "last_profile", "profile_stream", "write_stream"]
