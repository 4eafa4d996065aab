"""DataFrame and Structured Streaming operators for workout and body-sensor data."""

__version__ = "0.1.0"
