"""Column helpers (plain Column-returning Python functions, no UDFs)."""

from footfall.functions.jsmath import (  # noqa: F401
    js_round,
    truthy_str,
    truthy_num,
    safe_div,
    round6,
    exact_sum,
)
from footfall.functions.timeparts import (  # noqa: F401
    micros_of,
    ts_of,
    hour_of_us,
    dow0_of_us,
    local_us,
    time_of_day,
)
