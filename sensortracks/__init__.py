"""sensortracks: multi-sensor position reports to moving-object tracks, on Spark.

Operators are plain DataFrame -> DataFrame functions grouped by area:

* ``sources``    feeds and formats (JSON, CSV, binary frames, keyed sink)
* ``functions``  Column-level geo, motion and ordering helpers
* ``operators``  table operators (validation, ticks, association, tracking,
                 track tables, health, evaluation)
* ``streaming``  Structured Streaming forms of the tick and tracker operators
* ``plans``      the registered queries over the driver's test tables
"""

from sensortracks.session import configure, get_session

__all__ = ["configure", "get_session"]
