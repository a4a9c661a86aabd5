"""labelscope: labelled-text analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``); nothing is collected unless its size is bounded by the
number of labels / classes / clusters and checked first.
"""

import sys as _sys

from labelscope.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]


def _ship_by_value() -> None:
    """Executors need no installed copy: functions of this package that run
    inside tasks (block kernels, encoders) are pickled with their code."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 -- older pickler: the package must then be on the executors' path
        pass


_ship_by_value()
