from apexframe.functions.columns import (  # noqa: F401
    base_feature,
    dnf_label,
    half_even,
    home_flag,
    lenient,
    position_weight,
    race_id,
    race_weight,
    rain_flag,
    split_bucket,
    strip,
)
from apexframe.functions.times import days_apart, parse_date, signed_days, time_to_ms  # noqa: F401
