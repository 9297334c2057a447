"""lakeloom: a PySpark-native engine for landing, staging, modelling and
governing business data (telemetry landing with quarantine and load log,
CDC staging, a sales mart, data-quality checks, masking, entitlements and
column-access audit). Everything runs on the DataFrame API and Spark SQL."""

__version__ = "0.1.0"
