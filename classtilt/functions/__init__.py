from classtilt.functions.distributions import (
    fn_chi2_sf,
    fn_norm_cdf,
    fn_range_sf,
    fn_signed_rank_null,
    rank_sum_tail,
)
from classtilt.functions.hashing import fn_hash_uniform, hash_key, order_hash
from classtilt.functions.numbering import explode_counts, number_by_hash
from classtilt.functions.quantile import exact_quantile
from classtilt.functions.ranks import fn_avg_rank

__all__ = [
    "exact_quantile",
    "explode_counts",
    "fn_avg_rank",
    "fn_chi2_sf",
    "fn_hash_uniform",
    "fn_norm_cdf",
    "fn_range_sf",
    "fn_signed_rank_null",
    "hash_key",
    "number_by_hash",
    "order_hash",
    "rank_sum_tail",
]
