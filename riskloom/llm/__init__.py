"""Training-data operators: filters, fingerprints, classifiers, deduplication,
mixing, search and packing as Spark jobs.  Nothing else in the library imports
this subpackage."""
