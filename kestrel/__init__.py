"""kestrel: order-risk, evaluation, retrieval and support-message analytics on Spark.

Every operator is a DataFrame-in, DataFrame-out function.  Sub-packages:

* ``sources``   - table scans and sinks (parquet/CSV/JSON/text, model directories)
* ``functions`` - column-expression builders (hash uniforms, rules, text patterns)
* ``operators`` - relational operators (features, prep, models, evaluation, retrieval, messages)
* ``plans``     - named query plans over the driver tables, plus their DuckDB oracle SQL
* ``streaming`` - the per-conversation stateful stream
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Serialise this package's functions by value into Spark tasks.

    Executors then need only pyspark/numpy/pandas, not this package on their path: the
    pandas UDFs, the top-k scorer and the stream's state function travel with the task.
    """
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference pickling
        pass


_ship_by_value()
