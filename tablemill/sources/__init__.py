"""Sources and sinks."""

from tablemill.sources.registry import capabilities, open_source, register_all

__all__ = ["capabilities", "open_source", "register_all"]
