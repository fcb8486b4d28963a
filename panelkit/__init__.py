"""panelkit: Spark-native analytics for time-indexed panels.

Data model: a panel is a DataFrame keyed by ``(series_id, t)`` where ``t`` is
an ordering key (DATE, TIMESTAMP or integer).  Wide panels carry one column per
feature; long panels carry ``(series_id, t, feature, value)`` so that work is
spread over series *and* features.
"""

from panelkit.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
