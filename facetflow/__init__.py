"""Surface-inspection analytics as DataFrame operators on Spark."""
