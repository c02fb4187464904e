"""clausewise — clause segmentation, classification and precursor analytics on Spark.

Every public operator takes and returns DataFrames (or Columns, for the scalar
helpers in :mod:`clausewise.functions`).  Nothing is collected to the driver
except model fits and convergence counts of iterative jobs.
"""

from clausewise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
