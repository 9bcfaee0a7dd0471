from test_detect import SCHEMA, T0, event, frame

__all__ = ["SCHEMA", "T0", "event", "frame"]
