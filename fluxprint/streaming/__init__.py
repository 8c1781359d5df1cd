"""Streaming operators; their processors travel with the tasks."""

from pyspark.cloudpickle import register_pickle_by_value

from fluxprint import schemas
from fluxprint.streaming import processors

# Executors need no copy of the library: what a processor needs is sent with it.
for module in (schemas, processors):
    register_pickle_by_value(module)
