"""Satellite-coverage analytics and training-data operators as Spark plans."""
