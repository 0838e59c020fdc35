"""riskloom: tabular risk records -> prompts, splits, evaluation, fairness and
instruction-tuning data, expressed as plain Spark DataFrame transformations.

Every operator has the shape ``fn(df, *, params) -> DataFrame`` so it composes
with ``df.transform``; nothing is collected to the driver.
"""

__version__ = "0.1.0"

# Functions from this package that run inside Python workers (the scorer in
# mapInPandas, pandas UDFs, stateful streaming functions) are pickled by
# value, so executors need no copy of the package on their import path.
try:  # pragma: no cover - depends on the installed pyspark
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
