"""tallyweave: weak-supervision labelling, sampling and prevalence estimation as Spark plans.

Every public operator takes DataFrames and column names and returns a DataFrame; nothing here
collects rows that grow with the corpus.
"""

__version__ = "0.1.0"
