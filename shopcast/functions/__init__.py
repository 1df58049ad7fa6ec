from shopcast.functions.timebins import (  # noqa: F401
    as_datetime, ts_lit, date_lit, window_start, calendar_day, hour_of_day,
    calendar_distance, elapsed_days, elapsed_hours, parse_reg_date,
    days_registered, exp_decay, interval_bucket, cast_int,
)
from shopcast.functions.exprs import (  # noqa: F401
    one_hot, recode, row_sum, safe_ratio, nonpositive_to, flag, rounded,
)
