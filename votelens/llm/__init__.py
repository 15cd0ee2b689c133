"""Training-data operators: scoring, scanning, deduplication, decontamination, tokenisation and classification of text.

Nothing outside this package imports it. ``load()`` returns the registered queries and their SQL."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load():
    from votelens.llm import registry
    return registry.QUERIES, registry.SQL
