"""pagefold: Spark-native analytics over tables of saved web pages.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
DataFrame / SQL expressions; Python workers are used only to shred HTML
into a node table (``operators.dom.dom_shred``) and for keyed state with
variable expiry in ``streaming``.
"""

from pagefold.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
