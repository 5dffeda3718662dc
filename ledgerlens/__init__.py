"""ledgerlens: statement analytics as plain Spark DataFrame functions.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``) built from native Spark SQL expressions, keyed by
``statement_id`` so that one call handles any number of statements.
"""

from ledgerlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
