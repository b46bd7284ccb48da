"""tessera: reusable data-analysis operators expressed on Spark DataFrames.

Sub-packages
------------
sources    readers and writers for the input formats, plus stand-in tables
functions  column expressions (casts, parsing, mapping) and distribution functions
operators  profiling, preparation, summaries, ranks, tests, sampling, models, evaluation,
           basket and text mining, count models
plans      end-to-end studies and the registry of named queries
streaming  the same row-wise cleaning applied to a streaming source
"""

from tessera.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
