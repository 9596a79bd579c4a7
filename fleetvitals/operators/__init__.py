"""DataFrame-to-DataFrame operators. All take column names and thresholds, none collects.

``scope`` (default empty) names columns that separate independent worlds, usually
``server_name, snapshot_ts``: they lead every group, join key and window.
"""

from .aggregation import (
    count_by,
    count_per_member,
    counter_delta,
    counter_pair_ratio,
    global_ratio,
    pages_to_mb,
    smoothed_average,
    throughput_by_month,
)
from .extraction import event_time_from_ticks, log_lines, payload_history, rollover_events
from .joins import (
    advantage_score,
    detail_over_threshold,
    dimension_listing,
    distinct_lateral,
    last_update,
    lateral_attribute_rollup,
    lateral_rows,
    lateral_summary,
    lateral_top,
    setting_breach,
    union_hierarchy_count,
)
from .listing import (
    drop_exact_duplicates,
    flagged_members,
    gauge,
    key_value_pick,
    scoped_listing,
    size_history,
    unit_projection,
)
from .ranking import (
    coverage_topk,
    first_n_samples,
    latest_per_group,
    recent_n,
    running_totals,
    share_rank,
    top_volatile,
)

__all__ = [
    "advantage_score",
    "count_by",
    "count_per_member",
    "counter_delta",
    "counter_pair_ratio",
    "coverage_topk",
    "detail_over_threshold",
    "dimension_listing",
    "distinct_lateral",
    "drop_exact_duplicates",
    "event_time_from_ticks",
    "first_n_samples",
    "flagged_members",
    "gauge",
    "global_ratio",
    "key_value_pick",
    "last_update",
    "latest_per_group",
    "lateral_attribute_rollup",
    "lateral_rows",
    "lateral_summary",
    "lateral_top",
    "log_lines",
    "pages_to_mb",
    "payload_history",
    "recent_n",
    "rollover_events",
    "running_totals",
    "scoped_listing",
    "setting_breach",
    "share_rank",
    "size_history",
    "smoothed_average",
    "throughput_by_month",
    "top_volatile",
    "union_hierarchy_count",
    "unit_projection",
]
