"""Second-order operators: a function over records, groups, pairs or pairs of groups makes a parallel operator."""

from millrace.operators.generic import cogroup, combine_reduce, cross, groups_cogroup, groups_reduce, map_, match, reduce_, self_match, sorted_reduce, temp, union
from millrace.operators.hints import Hints
from millrace.operators.iterate import bulk, delta
from millrace.operators.keys import require_keys
from millrace.operators.relational import anti, coalesce_union, distinct, except_, group_difference, intersect, keep_least, outer, semi, theta

__all__ = [
    "Hints", "anti", "bulk", "coalesce_union", "cogroup", "combine_reduce", "cross", "delta", "distinct", "except_", "group_difference", "intersect",
    "groups_cogroup", "groups_reduce", "keep_least", "map_", "match", "outer", "reduce_", "require_keys", "self_match", "semi", "sorted_reduce", "temp", "theta", "union",
]
