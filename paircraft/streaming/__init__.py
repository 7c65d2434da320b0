"""Incremental processing.

The reference has no streaming operators (no watermarks, windows or state);
its only incremental behaviours are the append-only metric log and "resume
only what is not done yet". ``log_follow`` covers both with Structured
Streaming: new log files are parsed once, progress lives in the checkpoint.
"""
