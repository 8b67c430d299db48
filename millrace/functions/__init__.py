"""Warehouse-dialect functions as Columns. Semi-structured values are JSON text outside and VARIANT inside; no Python UDFs."""

from .aggregates import array_agg, listagg, object_agg
from .arrays import (array_append, array_cat, array_construct, array_construct_compact, array_contains, array_distinct, array_flatten, array_position, array_prepend, array_size,
                     array_slice, flatten_array)
from .conditional import decode, div0, div0null, iff, ifnull, nullifzero, nvl, nvl2, trunc_number, truncate, zeroifnull
from .dates import dateadd, datediff, dayname, last_day, monthname, to_date, to_timestamp, try_to_date
from .objects import get, get_path, object_construct, object_construct_keep_null, object_delete, object_insert, object_keys, object_pick
from .sql import register
from .strings import (charindex, contains, endswith, lpad, regexp_count, regexp_like, regexp_replace, regexp_substr, reverse, rpad, sha1, sha2, split, startswith, strtok,
                      strtok_to_array, translate, try_to_boolean, try_to_number)
from .values import (canonical, is_array, is_boolean, is_decimal, is_integer, is_null_value, is_object, json_value, parse_json, to_array, to_json, to_object, to_variant,
                     try_parse_json, typeof)
from .windows import conditional_change_event, conditional_true_event, ratio_to_report

__all__ = [n for n in dir() if not n.startswith("_")]
