from shopcast.sources.adapters import (  # noqa: F401
    Dates, DATES_A, DATES_B, table, actions_from_events, actions_from_lineitem,
    users_from_customer, products_from_part, products_from_part_b, comments_from_part,
    load_a, load_b,
)
from shopcast.sources.files import (  # noqa: F401
    scan_actions, scan_users, scan_products, scan_comments, category_slice,
    land_actions, materialize, read_candidates, feature_path,
)
from shopcast.sources.sinks import (  # noqa: F401
    top_users, write_user_submission, write_scores, final_submission,
)
