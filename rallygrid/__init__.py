"""rallygrid: racket-sport movement measures over tables of many clips, on Spark.

Every public operator takes and returns DataFrames.  ``clip_id`` leads every
key, and nothing assumes that a clip (or one track in it) is small: see
``rallygrid.functions.ordered`` for the block layout behind all sequence work.
"""
__version__ = "0.1.0"
