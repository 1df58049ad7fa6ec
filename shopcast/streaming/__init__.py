"""Structured Streaming: incremental maintenance of the daily activity table
from which the cube for any end date is derived (see ``daily_cube``)."""

from shopcast.streaming.daily_cube import (  # noqa: F401
    cube_from_daily, daily_partials, merge_partials, read_daily, start_daily_cube,
)
