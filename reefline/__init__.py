"""Conservation-coverage analytics on Spark."""
