"""Network intrusion analytics as Spark DataFrame and Structured Streaming jobs."""

from wirelark.config import AlertConfig, CaptureConfig, DetectionConfig

__all__ = ["AlertConfig", "CaptureConfig", "DetectionConfig"]
