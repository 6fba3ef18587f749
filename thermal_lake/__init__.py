"""thermal_lake: gridded thermal imagery and point-event analytics as lazy Spark operators."""

__version__ = "0.1.0"
