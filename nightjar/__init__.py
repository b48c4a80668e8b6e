"""nightjar: interval and time-series feature engineering plus leakage-safe
model evaluation for wearable and sensor data, as Spark DataFrame operators."""
__version__ = "0.1.0"
