from citespark.functions.columns import *  # noqa: F401,F403
from citespark.functions.pairs import nest, shared_item_pairs, unnest  # noqa: F401
from citespark.functions.ranks import (  # noqa: F401
    average_ranks,
    numbered,
    occurrence_numbers,
    ordered_histogram,
    percent_ranks,
    quantiles,
    scalar_quantile,
    top_per_group,
)
