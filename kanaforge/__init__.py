"""kanaforge: parallel-text corpus building, cleaning and scoring as Spark jobs.

Sub-packages
------------
functions   Column -> Column helpers (text rules, fixed constants).
sources     readers and writers (line files, tagged dumps, split datasets).
operators   DataFrame -> DataFrame operators (filters, joins, index/splits,
            vocabulary, lexicon, category walk, metrics, model-facing data).
plans       the query catalogue over the driver's tables, with oracle SQL.
streaming   the stateless scoring operators applied to a streaming DataFrame.
"""

__version__ = "0.1.0"


def _ship_with_tasks() -> None:
    """Pickle this package's functions by value, so Python workers (and executors on a
    cluster) run its UDFs without having the package installed or on their path."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark missing
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_with_tasks()
